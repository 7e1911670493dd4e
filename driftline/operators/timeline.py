"""Ranks and running values that never gather a whole key in one task.

A key (a path, a device, a vault) may hold a large part of all rows, so a plain
``Window.partitionBy(key)`` is not used for unbounded groups. Instead the timeline of
each key is cut in buckets: rows are ranked or accumulated inside ``(key, bucket)``, and
one summary row per bucket carries the value over from the buckets before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.skew import join_facts
from driftline.session import materialise


def time_bucket(ts: Column, width: int) -> Column:
    """Number of the bucket of ``width`` that holds ``ts`` (both long)."""
    return F.floor(ts / F.lit(width)).cast("long")


def fitted_bucket(df: DataFrame, keys: Sequence[str], width: int, most: int = 100_000, ts: str = "ts_ms") -> DataFrame:
    """Add ``_fit``, a bucket of ``width`` of the key's timeline, cut in equal parts where it holds more than ``most`` rows.

    So a busy key goes to as many tasks as its rows ask for, however short the time they fall in; rows of one key and one
    time stay together. Orders as ``ts`` does.
    """
    wide = df.withColumn("_wide", time_bucket(F.col(ts), width))
    crowded = wide.groupBy(*keys, "_wide").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    parts = F.least(F.ceil(F.col("_n") / most), F.lit(width)).cast("long")
    rows = join_facts(wide, crowded.select(*keys, "_wide", parts.alias("_parts")), [*keys, "_wide"], [ts])
    inside = F.floor((F.col(ts) - F.col("_wide") * width) * F.coalesce("_parts", F.lit(1)) / width).cast("long")
    return rows.withColumn("_fit", F.struct(F.col("_wide").alias("wide"), inside.alias("part"))).drop("_wide", "_parts")


def _summary(kind: str, value: Column, order: Column) -> Column:
    if kind in ("sum", "total"):
        return F.sum(value)
    if kind == "min":
        return F.min(value)
    if kind == "max":
        return F.max(value)
    return F.max_by(value, F.when(value.isNotNull(), order))  # last non-null


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running values in key order.

    ``specs`` maps an output name to ``(kind, value)`` with kind ``sum``, ``min``, ``max``
    or ``last`` (last non-null), or ``total`` for the sum over the whole key. ``order`` must
    be total inside a key and must agree with the order of ``bucket``. Without ``inclusive``
    the row itself does not count.
    """
    keys = list(keys)
    part = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    for name, (_, value) in specs.items():
        rows = rows.withColumn(f"_v_{name}", value)

    order_key = F.struct(*order)
    sums = rows.groupBy(*part).agg(
        *[_summary(kind, F.col(f"_v_{name}"), order_key).alias(f"_s_{name}") for name, (kind, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = sums.select(
        *part,
        *[
            (F.sum(f"_s_{name}").over(whole) if kind == "total" else _over(kind, F.col(f"_s_{name}"), before)).alias(f"_c_{name}")
            for name, (kind, _) in specs.items()
        ],
    )

    end = 0 if inclusive else -1
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = rows
    for name, (kind, _) in specs.items():
        if kind != "total":
            out = out.withColumn(f"_i_{name}", _over(kind, F.col(f"_v_{name}"), inside))
    out = out.join(carried, part, "left")
    for name, (kind, _) in specs.items():
        if kind == "total":
            out = out.withColumn(name, F.col(f"_c_{name}"))
            continue
        own, old = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0))
        elif kind == "min":
            value = F.least(own, old)
        elif kind == "max":
            value = F.greatest(own, old)
        else:
            value = F.coalesce(own, old)
        out = out.withColumn(name, value)
    drop = ["_bucket"] + [f"{p}{n}" for n in specs for p in ("_v_", "_i_", "_c_")]
    return out.drop(*drop)


def running_rank(df: DataFrame, keys, bucket: Column, order, name: str) -> DataFrame:
    """1-based rank of each row in its key."""
    return running(df, keys, bucket, order, {name: ("sum", F.lit(1).cast("long"))})


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Two rounds: the first ranks inside ``(group, salt)``, so a hot group is spread over
    ``salts`` tasks; the second ranks at most ``salts * n`` survivors of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final))
        .filter(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in a total order, without one task seeing all rows.

    Rows are range-partitioned and sorted; the row id of Spark then holds the partition in
    its upper bits and the place inside it in the lower 33. The row counts of the
    partitions (one row each, so bounded by the number of partitions) give the offsets.
    The ids depend on the partitioning, so they are written down before they are used twice.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_id", "_offset")
    )


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, spread: Sequence[str]) -> DataFrame:
    """1-based position of each row in its group: its global position less that of the group's first row."""
    placed = global_rank(df, [*(F.col(k).asc() for k in keys), *order], name)
    starts = placed.groupBy(*keys).agg((F.min(name) - 1).alias("_start"))
    return join_facts(placed, starts, keys, spread, "inner").withColumn(name, F.col(name) - F.col("_start")).drop("_start")


@dataclass(frozen=True)
class By:
    """One key of an order. Nulls come first in rising order and last in falling order."""

    column: Column
    descending: bool = False

    @property
    def sort(self) -> Column:
        return self.column.desc() if self.descending else self.column.asc()

    def digits(self, kind: T.DataType) -> Iterator[Column]:
        """Numbers that rise with the order, the first one deciding; equal numbers leave it open. Some types have none.

        They have at most 53 bits, as sketches compute in doubles.
        """
        if isinstance(kind, T.StringType):
            parts = (F.substring(F.encode(self.column, "UTF-8"), 6 * i + 1, 6) for i in count())
            numbers = (F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("long") for part in parts)
        elif isinstance(kind, (T.TimestampType, T.DateType, T.IntegralType, T.BooleanType)):
            whole = F.unix_micros(self.column) if isinstance(kind, T.TimestampType) else F.unix_date(self.column) if isinstance(kind, T.DateType) else self.column
            whole = whole.cast("long")
            numbers = iter([F.shiftright(whole, 20), whole.bitwiseAND(F.lit((1 << 20) - 1))])
        else:
            numbers = iter([])
        for number in numbers:
            yield F.coalesce(F.bitwise_not(number), F.lit(MOST)) if self.descending else F.coalesce(number, F.lit(LEAST))


LEAST, MOST = -(1 << 53), 1 << 53
#: rows that a page may skip by sorting; rank errors of the sketch, as one part of so many
SKIP, ACCURACY = 1_000, 10_000


def _first_of_page(df: DataFrame, keys: Sequence[By], skip: int) -> tuple[Column, int]:
    """A lower bound in the order, as a filter, and the number of rows before it, which is at most ``skip``.

    Key by key, a sketch of the key's numbers tells near which value the row after ``skip`` lies, and exact counts around
    it say on which side. The driver sees some counts; rows are only counted. It ends when the bound is near enough, or
    with the last number of the last key.
    """
    kinds = [f.dataType for f in df.select(*[k.column.alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    same, before = [], 0  # numbers that the row is known to have; rows before all that have them
    for key, kind in zip(keys, kinds):
        exact = isinstance(kind, (T.StringType, T.TimestampType, T.DateType, T.IntegralType, T.BooleanType))
        for digit in key.digits(kind):
            if skip - before <= SKIP:
                break
            rows = df
            for d, v in same:
                rows = rows.filter(d == v)
            lo, hi, value = LEAST, MOST, None
            rows = rows.select(digit.alias("d"))
            while value is None and skip - before > SKIP:
                inside = rows.filter(F.col("d").between(lo, hi))
                n = inside.count()
                at = skip - before
                if n <= at:  # the page begins behind all rows
                    return F.lit(False), before + n
                shares = [min(1.0, max(0.0, (at + 1) / n + e / ACCURACY)) for e in (-2, 0, 2)]
                low, near, high = inside.agg(F.percentile_approx("d", shares, ACCURACY).alias("q")).first().q
                less, below, upto, most = inside.agg(
                    F.count_if(F.col("d") < low), F.count_if(F.col("d") < near), F.count_if(F.col("d") <= near), F.count_if(F.col("d") <= high)
                ).first()
                if below <= at < upto:
                    value, before = near, before + below
                elif at < below:
                    lo, hi, before = (low, near - 1, before + less) if less <= at else (lo, near - 1, before)
                else:
                    lo, hi, before = near + 1, high if at < most else hi, before + upto
            if value is None:
                return _from(same, digit, lo), before
            same.append((digit, value))
            text = value if not key.descending else ~value
            if isinstance(kind, T.StringType) and (text in (LEAST, MOST) or text & 255 == 0):
                break  # the text ends here
        if skip - before <= SKIP or not exact:
            break
    return (_from(same[:-1], *same[-1]) if same else F.lit(True)), before


def _from(same: Sequence[tuple[Column, int]], digit: Column, least: int) -> Column:
    bound = digit >= least
    for d, v in reversed(same):
        bound = (d > v) | ((d == v) & bound)
    return bound


def page_of(df: DataFrame, order: Sequence[By | Column], page: int, page_size: int) -> DataFrame:
    """Rows of one page of an ordered table, whatever the depth.

    With keys given as ``By`` the start of the page is found by counting, and each task then gives on no more rows than the
    page and those skipped; nothing is sorted whole or written down. ``df`` is read several times for a deep
    page, so store it if it is dear. Plain sort columns can't be looked into: their rows are ranked one and all.
    """
    end = page * page_size
    if not all(isinstance(k, By) for k in order):
        ranked = global_rank(df, [k.sort if isinstance(k, By) else k for k in order], "_pos")
        return ranked.filter((F.col("_pos") > end - page_size) & (F.col("_pos") <= end)).drop("_pos")
    bound, before = _first_of_page(df, order, end - page_size)
    return df.filter(bound).orderBy(*[k.sort for k in order]).offset(end - page_size - before).limit(page_size)
