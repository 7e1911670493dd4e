"""Version history: diffs as lines, texts before and after, versions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.timeline import running

VERSION = ["note_id", "version"]
#: versions per bucket when the versions of one note are walked
VERSION_BUCKET = 1024


def diff_to_lines(history: DataFrame) -> DataFrame:
    """Segments of each line of a diff (``diffs``: array of type and text; 1 add, -1 delete, 0 same).

    A text with several pieces gives no segment for an empty piece. ``line_no`` counts from 0. One
    history row is one value, so the window below holds the pieces of one row only.
    """
    pieces = history.select(*VERSION, F.posexplode("diffs").alias("_d", "_diff")).select(
        *VERSION, "_d", F.col("_diff.type").alias("type"), F.split("_diff.text", "\n").alias("_texts")
    )
    flat = pieces.select(*VERSION, "_d", "type", F.size("_texts").alias("_n"), F.posexplode("_texts").alias("_i", "text"))
    order = Window.partitionBy(*VERSION).orderBy("_d", "_i").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flat.withColumn("line_no", F.sum(F.when(F.col("_i") > 0, 1).otherwise(0)).over(order).cast("long"))
    shown = numbered.filter((F.col("text") != "") | (F.col("_n") == 1))
    segment = Window.partitionBy(*VERSION, "line_no").orderBy("_d", "_i")
    return shown.select(
        *VERSION, "line_no", (F.row_number().over(segment) - 1).cast("long").alias("segment_no"), "type", "text"
    )


def number_diff_lines(segments: DataFrame) -> DataFrame:
    """Lines with ``has_change`` and the number a line gets at its first segment that is no delete."""
    lines = segments.groupBy(*VERSION, "line_no").agg(
        F.bool_or(F.col("type") != 0).alias("has_change"),
        F.bool_or(F.col("type") != -1).alias("_counts"),
        F.bool_or(F.col("type") == 1).alias("has_add"),
    )
    order = Window.partitionBy(*VERSION).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("_counts").cast("long")).over(order)
    return lines.select(
        *VERSION, "line_no", "has_change", "has_add", F.when(F.col("_counts"), number).alias("line_number")
    )


def changed_lines(lines: DataFrame) -> DataFrame:
    """Only lines with a change, with ``is_pure_delete``."""
    return lines.filter("has_change").withColumn("is_pure_delete", F.col("line_number").isNull())


def rebuild_versions(history: DataFrame) -> DataFrame:
    """Text before (same and deleted pieces) and after (same and added pieces) of each diff."""

    def text(without: int) -> Column:
        kept = F.filter("diffs", lambda d: d["type"] != without)
        return F.array_join(F.transform(kept, lambda d: d["text"]), "")

    return history.select(*VERSION, text(1).alias("text_before"), text(-1).alias("text_after"))


def version_steps(history: DataFrame) -> DataFrame:
    """Versions with their place from the newest, and the text of the version before.

    Versions of a note are walked in buckets, so a note with very many versions is split.
    """
    one = F.lit(1).cast("long")
    walked = running(
        history,
        ["note_id"],
        F.floor(F.col("version") / VERSION_BUCKET).cast("long"),
        ["version"],
        {"_older": ("sum", one), "_total": ("total", one), "_prev": ("last", F.struct("version", "content"))},
        inclusive=False,
    )
    return walked.select(
        *VERSION,
        (F.col("_total") - F.col("_older")).alias("newest_rank"),
        F.col("_prev.version").alias("prev_version"),
        F.col("_prev.content").alias("text_before"),
    )


def restore_version(history: DataFrame, note_id, version: int, now: int) -> DataFrame:
    """History with the chosen version of a note added again as its newest."""
    mine = history.filter(F.col("note_id") == note_id)
    top = mine.agg(F.max("version").alias("v")).scalar()
    again = (
        mine.filter(F.col("version") == version)
        .withColumn("version", (top + 1).cast("long"))
        .withColumn("created_at", F.lit(now).cast("long"))
    )
    return history.unionByName(again)


def line_changes(history: DataFrame) -> DataFrame:
    """Lines whose number of copies differs between a version and the one before.

    Lines are counted per version before versions are compared; text order plays no part.
    """
    steps = version_steps(history.select(*VERSION, F.lit("").alias("content")))
    links = steps.filter(F.col("prev_version").isNotNull()).select(*VERSION, "prev_version")
    ends = F.array(
        F.struct(F.col("prev_version").alias("version"), F.col("version").alias("next"), F.lit(False).alias("has_prev")),
        F.struct(F.col("version"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("has_prev")),
    )
    around = (
        links.select("note_id", F.explode(ends).alias("_e"))
        .groupBy("note_id", F.col("_e.version").alias("version"))
        .agg(F.max("_e.next").alias("_next"), F.bool_or("_e.has_prev").alias("_has_prev"))
    )
    linked = history.select(*VERSION, "content").join(around, VERSION)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # a line counts as "after" for its own version and as "before" for the next one
    roles = F.filter(
        F.array(
            F.struct(F.when(F.col("_has_prev"), F.col("version")).alias("version"), one.alias("after"), zero.alias("before")),
            F.struct(F.col("_next").alias("version"), zero.alias("after"), one.alias("before")),
        ),
        lambda r: r["version"].isNotNull(),
    )
    lines = linked.withColumn("line", F.explode(F.split("content", "\n"))).select(
        "note_id", "line", F.explode(roles).alias("_r")
    )
    return (
        lines.groupBy("note_id", F.col("_r.version").alias("version"), "line")
        .agg(F.sum("_r.after").alias("n_after"), F.sum("_r.before").alias("n_before"))
        .filter(F.col("n_after") != F.col("n_before"))
    )
