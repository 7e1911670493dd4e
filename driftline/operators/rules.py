"""Include and exclude rules.

Rules come from a setting, so they are few and known on the driver. They are folded into
one regular expression per letter-case mode; matching is a plain predicate that Spark
evaluates in the scan stage, without a join and without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.paths import extension, slashed

RULES_SCHEMA = "scope string, ord int, pattern string, case_sensitive boolean"
# Fixed value: prefix of paths that stand for key-value items.
VIRTUAL_PREFIX = "_localStorage/"


@dataclass(frozen=True)
class Rule:
    pattern: str
    case_sensitive: bool = False
    is_regex: bool = True


@dataclass(frozen=True)
class RuleBook:
    """Rules by scope. ``internal`` holds paths that are never synced as config."""

    whitelist: tuple[Rule, ...] = ()
    extensions: tuple[Rule, ...] = ()
    folders: tuple[Rule, ...] = ()
    internal: tuple[Rule, ...] = field(default=())


def parse_rules(text: str | None) -> list[Rule]:
    """Rules of a setting: a JSON array of patterns or objects, else one pattern per line."""
    text = (text or "").strip()
    if not text:
        return []
    if text.startswith("[") and text.endswith("]"):
        try:
            items = json.loads(text)
        except ValueError:
            items = None
        if isinstance(items, list):
            found = []
            for item in items:
                if isinstance(item, str):
                    found.append(Rule(item))
                elif isinstance(item, dict):
                    found.append(Rule(item.get("pattern") or "", bool(item.get("caseSensitive"))))
            return [r for r in found if r.pattern]
    return [Rule(line.strip()) for line in re.split(r"\r?\n", text) if line.strip()]


def write_rules(rules: Iterable[Rule]) -> str:
    """The JSON form of rules; empty text for none."""
    items = [{"pattern": r.pattern, "caseSensitive": r.case_sensitive} for r in rules]
    return json.dumps(items, ensure_ascii=False, separators=(",", ":")) if items else ""


def check_rules(spark: SparkSession, rules: Iterable[Rule]) -> list[Rule]:
    """Mark rules whose pattern is no valid regular expression; they keep only the prefix match.

    The probe is folded while planning: it starts no job on the cluster.
    """

    def compiles(pattern: str) -> bool:
        try:
            spark.sql("SELECT '' RLIKE :p", args={"p": "^" + pattern}).collect()
        except PySparkException:
            return False
        return True

    return [replace(r, is_regex=compiles(r.pattern)) for r in rules]


def load_rules(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """Rules of all scopes as a table, from ``{scope: setting text}``."""
    rows = [
        (scope, i, r.pattern, r.case_sensitive)
        for scope, text in settings.items()
        for i, r in enumerate(parse_rules(text))
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def load_rule_book(
    spark: SparkSession, whitelist: str = "", extensions: str = "", folders: str = "", internal: Iterable[str] = ()
) -> RuleBook:
    return RuleBook(
        tuple(check_rules(spark, parse_rules(whitelist))),
        tuple(parse_rules(extensions)),
        tuple(check_rules(spark, parse_rules(folders))),
        tuple(check_rules(spark, [Rule(p) for p in internal])),
    )


def rule_book_of(spark: SparkSession, rules: DataFrame) -> RuleBook:
    """Rule book from a rules table (a setting: at most some hundreds of rows)."""
    by_scope: dict[str, list[Rule]] = {}
    for row in rules.orderBy("scope", "ord").collect():
        by_scope.setdefault(row.scope, []).append(Rule(row.pattern, row.case_sensitive))
    return RuleBook(
        tuple(check_rules(spark, by_scope.get("whitelist", []))),
        tuple(by_scope.get("extension", [])),
        tuple(check_rules(spark, by_scope.get("folder", []))),
        tuple(check_rules(spark, by_scope.get("internal", []))),
    )


_OWN_GROUPS = re.compile(r"\\[1-9k]|\(\?<[A-Za-z]")


def _any_of(column: Column, patterns: list[str], flags: str) -> Column:
    """True where one of the patterns is found. Patterns that refer to groups stay alone."""
    joined = [p for p in patterns if not _OWN_GROUPS.search(p)]
    alone = [p for p in patterns if _OWN_GROUPS.search(p)]
    texts = (["|".join(f"(?:{p})" for p in joined)] if joined else []) + alone
    hit = F.lit(False)
    for i, text in enumerate(texts):
        found = column.rlike(flags + text)
        hit = found if i == 0 else hit | found
    return hit


def matches(path: Column, rules: Iterable[Rule]) -> Column:
    """True where a path meets a rule: the pattern found as a regular expression after ``^``
    (only the first branch of ``a|b`` is anchored), or the pattern itself as path or folder."""
    rules = list(rules)
    hit = F.lit(False)
    for sensitive, flags in ((False, "(?iu)"), (True, "")):
        mine = [r for r in rules if r.case_sensitive is sensitive]
        if not mine:
            continue
        regexes = ["^" + r.pattern for r in mine if r.is_regex]
        if regexes:
            hit = hit | _any_of(path, regexes, flags)
        folders = [re.escape(re.sub(r"/\Z", "", r.pattern.replace("\\", "/"))) for r in mine]
        hit = hit | _any_of(slashed(path), [rf"\A{p}(?:/|\z)" for p in folders], flags)
    return hit


def _extension_hit(path: Column, rules: Iterable[Rule]) -> Column:
    wanted = {p for r in rules for p in (r.pattern.lower(), "." + r.pattern.lower()) if p.startswith(".")}
    return extension(path).isin(sorted(wanted)) if wanted else F.lit(False)


def is_excluded(path: Column, book: RuleBook) -> Column:
    """Notes and attachments: a whitelist hit keeps; else extension, else folder rules drop."""
    p = slashed(path)
    return ~matches(p, book.whitelist) & (_extension_hit(p, book.extensions) | matches(p, book.folders))


def is_config_excluded(path: Column, book: RuleBook) -> Column:
    """Config files: whitelist, then internal paths, then folder rules. Extensions do not apply."""
    p = slashed(path)
    return ~matches(p, book.whitelist) & (matches(p, book.internal) | matches(p, book.folders))


def match_rules(df: DataFrame, rules: Iterable[Rule], path: str = "path", out: str = "matched") -> DataFrame:
    return df.withColumn(out, matches(F.col(path), rules))


def exclude_paths(df: DataFrame, book: RuleBook, path: str = "path") -> DataFrame:
    return df.filter(~is_excluded(F.col(path), book))


def exclude_config(df: DataFrame, book: RuleBook, path: str = "path") -> DataFrame:
    return df.filter(~is_config_excluded(F.col(path), book))


def purge_excluded(state: DataFrame, book: RuleBook) -> tuple[DataFrame, DataFrame]:
    """State rows that rules still allow, and the rows that are removed now."""
    gone = is_excluded(F.col("path"), book)
    return state.filter(~gone), state.filter(gone)


def custom_dirs(setting: str) -> list[str]:
    """Extra config folders of a setting, without slashes at the end."""
    dirs = (re.sub(r"/+\Z", "", r.pattern.strip()) for r in parse_rules(setting))
    return [d for d in dirs if d]


def in_config_scope(path: Column, config_dir: str, custom: Iterable[str]) -> Column:
    p = slashed(path)
    hit = p.startswith(config_dir + "/") | p.startswith(VIRTUAL_PREFIX)
    for d in custom:
        hit = hit | (p == d) | p.startswith(d + "/")
    return hit


def config_scope(df: DataFrame, config_dir: str, custom: str = "", path: str = "path") -> DataFrame:
    """Rows inside the config folder, the virtual folder or a custom folder."""
    return df.filter(in_config_scope(F.col(path), config_dir, custom_dirs(custom)))
