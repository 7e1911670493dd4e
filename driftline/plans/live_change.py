"""A live feed of changes: drop echoes, wait out bursts, turn renames into messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.acks import drop_shadowed, echo_window
from driftline.operators.rules import RuleBook, is_excluded
from driftline.operators.state import classify_renames
from driftline.operators.windows import debounce
from driftline.streaming.feeds import debounce_stream


def _sendable(events: DataFrame, book: RuleBook) -> DataFrame:
    messages = classify_renames(events, book)
    return messages.filter((F.col("op") == "rename") | ~is_excluded(F.col("path"), book))


def run(events: DataFrame, remote: DataFrame, book: RuleBook, delay_ms: int) -> DataFrame:
    """Messages to send for a table of events."""
    own = drop_shadowed(echo_window(events, remote), delay_ms)
    return _sendable(debounce(own, delay_ms), book)


def settle(events: DataFrame, book: RuleBook, delay_ms: int, late: str) -> DataFrame:
    """The last stage of the same for a feed.

    Dropping echoes and shadowed writes (``feeds.echo_stream``, ``feeds.shadow_stream``) waits on event
    time of its own, so these are queries before this one; the feed they write is read here. They
    hold rows back, so ``late`` must be longer than theirs.
    """
    return _sendable(debounce_stream(events, delay_ms, late), book)
