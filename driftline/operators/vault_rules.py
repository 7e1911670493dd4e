"""Rules of many vaults, as a table: each path meets the rules of its own vault, and no rule passes the driver.

A rule without special characters is a prefix, and every rule is also a folder name. Both are found by an equi join: a path is
cut at the lengths that the rules of its vault have, and (vault, prefix) is looked up. Only real regular expressions
are tried one by one, on the paths of the vaults that have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import extension, slashed
from driftline.operators.skew import join_facts

#: characters that make a pattern a regular expression
SPECIAL = r"[\\^$.|?*+()\[\]{}]"


def vault_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``vault, path, scope`` of the rules that distinct ``paths`` (``vault, path``) meet.

    ``rules`` has ``vault, scope`` (whitelist, extension or folder), ``pattern`` and ``case_sensitive``; null counts as false. Patterns that are
    regular expressions must be valid (see ``rules.check_rules``). Empty patterns and rules of other scopes meet nothing.
    """
    rules = rules.filter(F.col("pattern") != "").withColumn("exact", F.coalesce("case_sensitive", F.lit(False)))
    own = rules.filter(F.col("scope").isin("whitelist", "folder"))
    is_regex = F.col("pattern").rlike(SPECIAL)
    folder = F.regexp_replace(slashed(F.col("pattern")), r"/\z", "")
    keys = own.filter(~is_regex).select("vault", "scope", "exact", F.col("pattern").alias("key"), F.lit(False).alias("whole")).unionByName(
        own.select("vault", "scope", "exact", folder.alias("key"), F.lit(True).alias("whole"))
    )
    keys = keys.withColumn("key", F.when(F.col("exact"), F.col("key")).otherwise(F.lower("key"))).filter("key <> ''").distinct()
    cuts = keys.groupBy("vault").agg(F.collect_set(F.struct("exact", F.length("key").alias("n"))).alias("cuts"))  # lengths, so few
    rows = paths.select("vault", "path", slashed(F.col("path")).alias("p"))
    cut = join_facts(rows, cuts, ["vault"], ["path"], "inner").withColumn("c", F.explode("cuts")).filter(F.length("p") >= F.col("c.n"))
    cut = cut.select("vault", "path", "p", F.col("c.exact").alias("exact"), F.expr("substring(CASE WHEN c.exact THEN p ELSE lower(p) END, 1, c.n)").alias("key"))
    found = join_facts(cut, keys, ["vault", "exact", "key"], ["path"], "inner")
    ends = (F.length("p") == F.length("key")) | (F.expr("substring(p, length(key) + 1, 1)") == "/")
    by_name = found.filter(~F.col("whole") | ends).select("vault", "path", "scope")

    regexes = own.filter(is_regex).groupBy("vault", "scope").agg(
        F.collect_set(F.concat(F.when(F.col("exact"), "").otherwise("(?iu)"), F.lit("^"), "pattern")).alias("regexes")
    )
    tried = join_facts(rows, regexes, ["vault"], ["path"], "inner")
    by_regex = tried.filter(F.expr("exists(regexes, r -> p RLIKE r)")).select("vault", "path", "scope")

    low = F.lower("pattern")
    wanted = rules.filter("scope = 'extension'").select("vault", "scope", F.explode(F.array(low, F.concat(F.lit("."), low))).alias("ext"))
    wanted = wanted.filter(F.col("ext").startswith(".")).distinct()
    by_type = join_facts(rows.withColumn("ext", extension(F.col("p"))), wanted, ["vault", "ext"], ["path"], "inner").select("vault", "path", "scope")
    return by_name.unionByName(by_regex).unionByName(by_type).distinct()


def exclude_by_vault(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``df`` that the rules of their vault allow: a whitelist hit keeps, else an extension or folder rule drops."""
    hits = vault_hits(df.select("vault", "path").distinct(), rules)
    dropped = hits.groupBy("vault", "path").agg(F.bool_or(F.col("scope") == "whitelist").alias("kept")).filter("NOT kept")
    return df.join(dropped.select("vault", "path"), ["vault", "path"], "left_anti").select(*df.columns)
