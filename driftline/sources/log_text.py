"""The readable log file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.messages import SUMMARY_SCHEMA

# Labels and widths of the line format.
SUMMARY_LABELS = {"note": "Note", "file": "Attachment", "config": "Config"}
WIDTHS = {"type": 7, "category": 12, "status": 8, "action": 25}


def _padded(text: Column, width: int) -> Column:
    """Text filled with spaces to a width; longer text stays whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def _summary_text(message: Column) -> Column:
    parsed = F.from_json(message, SUMMARY_SCHEMA)
    parts = [
        F.when(
            parsed[kind].isNotNull(),
            F.format_string(
                label + "(up:%d,recv:%d,del:%d)", parsed[kind]["upload"], parsed[kind]["modify"], parsed[kind]["delete"]
            ),
        )
        for kind, label in SUMMARY_LABELS.items()
    ]
    mode = F.when(parsed["syncType"] == "full", "Full").otherwise("Incremental")
    text = F.concat(F.lit(" [Msg: Sync completed ("), mode, F.lit("): "), F.concat_ws(", ", *parts), F.lit("]"))
    return F.when(F.try_parse_json(message).isNotNull(), text)


def log_lines(log: DataFrame) -> DataFrame:
    """One fixed-width line per log row; summaries are written as text."""

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    time = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd HH:mm:ss")
    path = F.when(given("path"), F.concat(F.lit(" [Path: "), F.col("path"), F.lit("]"))).otherwise("")
    plain = F.concat(F.lit(" [Msg: "), F.replace("message", F.lit("\n"), F.lit(" ")), F.lit("]"))
    message = F.when(
        given("message"),
        F.coalesce(F.when(F.col("category") == "summary", _summary_text(F.col("message"))), plain),
    ).otherwise("")
    boxes = [F.concat(F.lit("["), _padded(F.upper(c), WIDTHS[c]), F.lit("] ")) for c in ("type", "category", "status")]
    line = F.concat(F.lit("["), time, F.lit("] "), *boxes, _padded(F.col("action"), WIDTHS["action"]), path, message)
    return log.select("id", "first_seq", line.alias("line"))


def write_log_text(log: DataFrame, path: str) -> None:
    """Append lines of finished rows; waiting rows are not written."""
    done = log.filter(F.col("status") != "pending")
    log_lines(done).orderBy("first_seq").select("line").write.mode("append").text(path)
