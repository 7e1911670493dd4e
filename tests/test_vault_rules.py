"""Rules of many vaults against the rule book of each."""

import random

from pyspark.sql import functions as F

from driftline.operators import rules, vault_rules

PARTS = ["a", "A", "ab", "b", "x.md", "X.MD", "p.png", "é"]
PATTERNS = ["a", "A/b", "ab/", "a.*d", "x.md", "^b", "(a|b)/x", "p", "é", "b/a/"]


def test_each_vault_has_its_own_rules(spark):
    rng = random.Random(3)
    paths = [(f"v{rng.randrange(6)}", "/".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 5)))) for _ in range(400)]
    table = [(f"v{v}", s, rng.choice([".md", "PNG", "md"]) if s == "extension" else rng.choice(PATTERNS), rng.choice([True, False, None]))
             for v in range(5) for s in ("whitelist", "extension", "folder", "folder", "other") if rng.random() < 0.8]
    df = spark.createDataFrame(paths, "vault string, path string").withColumn("scope", F.lit("own"))
    kept = vault_rules.exclude_by_vault(df, spark.createDataFrame(table, "vault string, scope string, pattern string, case_sensitive boolean"))
    got = sorted((r.vault, r.path) for r in kept.collect())
    want = []
    for v in {v for v, _ in paths}:
        def of(scope, v=v):
            return tuple(rules.Rule(p, bool(c)) for w, s, p, c in table if w == v and s == scope)

        book = rules.RuleBook(of("whitelist"), of("extension"), of("folder"))
        want += [(r.vault, r.path) for r in rules.exclude_paths(df.filter(F.col("vault") == v), book).collect()]
    assert got == sorted(want) and 0 < len(got) < len(paths) and kept.columns == df.columns
    none = spark.createDataFrame([], "vault string, scope string, pattern string, case_sensitive boolean")
    assert vault_rules.exclude_by_vault(df, none).count() == len(paths)
