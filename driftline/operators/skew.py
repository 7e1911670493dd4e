"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ways the rows of one key are spread
SALTS = 16


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join rows to a small table on ``keys``, such as facts per device.

    Rows carry a salt taken from ``spread`` and the facts are repeated once per salt, so the rows of
    one key go to ``salts`` tasks. Spark still broadcasts the facts when it measures them as small.
    """
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    return salted.join(facts.withColumn("_salt", every), [*keys, "_salt"], how).drop("_salt")
