"""Acknowledgements against what was sent, and echoes of what was applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.timeline import fitted_bucket, running, time_bucket
from driftline.schema import STATE_KEY

#: width of the time buckets that split the timeline of one key, in ms
BUCKET_MS = 3_600_000
# Fixed value: how long after a remote apply a local event is its echo.
ECHO_MS = 500


def _wait(name: str) -> Column:
    return F.col(f"_{name}_wait")


def _timeline(sent: DataFrame, acks: DataFrame, pushes: DataFrame | None) -> DataFrame:
    """Sends, pushes and acks of all paths as one table; at one time sends come first, acks last."""
    columns = [*STATE_KEY, "event_id", "ts_ms"]

    def rows(df: DataFrame, role: str, op: Column) -> DataFrame:
        def own(name: str, kind: str) -> Column:
            return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

        facts = [own("hash", "string"), own("mtime", "long"), own("size", "long"), own("last_time", "long")]
        return df.select(*columns, F.lit(role).alias("role"), op.alias("op"), *facts)

    two = F.when(F.col("op") == "delete", "delete").otherwise("modify")
    line = rows(sent, "0 send", two).unionByName(rows(acks, "2 ack", two).withColumn("hash", F.lit(None).cast("string")))
    return line if pushes is None else line.unionByName(rows(pushes, "1 push", F.col("op")))


def _setters() -> dict[str, tuple[str, Column]]:
    """What an event does to the write and to the delete that wait on its path.

    Every event either sets what waits, to a value or to nothing, or leaves it. So the transition of any stretch of
    events is its last setter, stretches are composed by taking the later one, and ``running`` folds them map-side.
    """
    role, op = F.col("role"), F.col("op")
    send, ack, push = role == "0 send", role == "2 ack", role == "1 push"
    put, drop = send & (op == "modify"), send & (op == "delete")
    no_put = drop | (ack & (op == "modify")) | (push & op.isin("modify", "mtime", "delete"))
    no_drop = put | (ack & (op == "delete")) | (push & op.isin("modify", "update"))
    facts = [F.col(c) for c in ("hash", "mtime", "size")]

    def waiting(begin: Column, end: Column) -> tuple[str, Column]:
        return "last", F.when(begin | end, F.struct(F.coalesce(begin, F.lit(False)).alias("is"), *facts))

    return {"_put_wait": waiting(put, no_put), "_drop_wait": waiting(drop, no_drop)}


def settle(
    sent: DataFrame, acks: DataFrame, pushes: DataFrame | None = None, bucket_ms: int = BUCKET_MS, most: int = 100_000
) -> DataFrame:
    """Effect of each acknowledgement and each push of the server on the state: ``put``, ``remove`` or ``none``.

    ``sent`` has ``op`` modify, create or delete with a ``hash`` (and ``mtime``, ``size``, if known); ``acks`` has ``op`` and
    ``last_time``. A modify ack puts the write that waits on its path, a delete ack takes the path out if a delete
    waits. A newer send of content cancels a delete that waits, a send of a delete the write.

    ``pushes`` has ``op``, ``hash``, ``mtime``, ``size`` and ``last_time``: ``modify`` brings content, so neither a write nor a delete waits any
    longer; ``mtime`` says that the server has the same content and puts the write that waits, with its time; ``delete``
    removes the path and cancels a write; ``update`` announces an attachment that comes in chunks, which cancels a
    delete and puts nothing yet.
    """
    line = _timeline(sent, acks, pushes)
    split = fitted_bucket(line, STATE_KEY, bucket_ms, most)
    line = running(split, STATE_KEY, F.col("_fit"), ["ts_ms", "role", "event_id"], _setters(), inclusive=False)
    line = line.filter(F.col("role") != "0 send")
    push, op = F.col("role") == "1 push", F.col("op")
    put_waits, drop_waits = (F.coalesce(_wait(n)["is"], F.lit(False)) for n in ("put", "drop"))
    own = push & (op == "modify")
    taken = F.when(push, op == "mtime").otherwise(op == "modify") & put_waits
    removed = F.when(push, op == "delete").otherwise((op == "delete") & drop_waits)
    return line.select(
        *STATE_KEY, "event_id", "ts_ms", F.substring("role", 3, 4).alias("source"), "op", "last_time",
        F.when(own | taken, "put").when(removed, "remove").otherwise("none").alias("effect"),
        F.when(own, F.col("hash")).when(taken, _wait("put")["hash"]).alias("hash"),
        F.when(own | (taken & push), F.col("mtime")).when(taken, _wait("put")["mtime"]).alias("mtime"),
        F.when(own, F.col("size")).when(taken, _wait("put")["size"]).alias("size"),
    )


def match_acks(sent: DataFrame, acks: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Effect of each path acknowledgement on the state, where the server pushes nothing (see :func:`settle`)."""
    rows = settle(sent, acks, None, bucket_ms)
    return rows.select(*STATE_KEY, "event_id", "ts_ms", "op", "last_time", "effect", "hash")


def still_waiting(sent: DataFrame, acks: DataFrame, pushes: DataFrame | None = None) -> DataFrame:
    """Writes and deletes that nothing has answered or cancelled, one row per path: what a client keeps for its next start."""
    order = F.struct("ts_ms", "role", "event_id")
    values = {name: value for name, (_, value) in _setters().items()}
    last = _timeline(sent, acks, pushes).groupBy(*STATE_KEY).agg(
        *[F.max_by(value, F.when(value.isNotNull(), order)).alias(name) for name, value in values.items()]
    )
    put, drop = (F.coalesce(_wait(n)["is"], F.lit(False)) for n in ("put", "drop"))
    return last.filter(put | drop).select(
        *STATE_KEY, F.when(put, "modify").otherwise("delete").alias("op"),
        *[F.when(put, _wait("put")[c]).alias(c) for c in ("hash", "mtime", "size")],
    )


def apply_effects(state: DataFrame, effects: DataFrame) -> DataFrame:
    """The state after effects (see :func:`settle`); of several on a path the latest counts.

    A ``put`` without a time or size keeps none: both become 0, so that the file is looked at again.
    """
    order = F.struct("ts_ms", (F.col("source") == "ack").alias("acked"), "event_id")
    last = effects.filter(F.col("effect") != "none").groupBy(*STATE_KEY).agg(
        F.max_by(F.struct("effect", "hash", "mtime", "size"), order).alias("_e")
    )
    put = F.col("_e.effect") == "put"
    zero = F.lit(0).cast("long")
    fresh = {"hash": F.col("_e.hash"), "mtime": F.coalesce("_e.mtime", zero), "size": F.coalesce("_e.size", zero)}
    return (
        state.select(*STATE_KEY, *fresh)
        .join(last, STATE_KEY, "full_outer")
        .filter(F.col("_e").isNull() | put)
        .select(*STATE_KEY, *[F.when(put, new).otherwise(F.col(c)).alias(c) for c, new in fresh.items()])
    )


def rename_effects(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Effects of acknowledged renames (see :func:`match_rename_acks`): the old path goes, the new one takes the hash sent.

    ``hashes`` gives ``event_id`` and ``hash`` (and ``mtime``, ``size``) of the renames.
    """
    acked = pairs.filter(F.col("acked_at").isNotNull()).drop("ts_ms").join(hashes.select("event_id", "hash", "mtime", "size"), "event_id")
    none = F.lit(None)
    two = F.array(
        F.struct(F.col("old_path").alias("path"), F.lit("remove").alias("effect"), none.cast("string").alias("hash"), none.cast("long").alias("mtime"), none.cast("long").alias("size")),
        F.struct("path", F.lit("put").alias("effect"), "hash", "mtime", "size"),
    )
    rows = acked.select("vault", "device", "event_id", F.col("acked_at").alias("ts_ms"), F.explode(two).alias("_e"))
    return rows.select("vault", "device", "_e.path", "event_id", "ts_ms", F.lit("ack").alias("source"), F.lit("rename").alias("op"),
                       none.cast("long").alias("last_time"), "_e.effect", "_e.hash", "_e.mtime", "_e.size")


def match_rename_acks(renames: DataFrame, acks: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Renames with the time of their acknowledgement, first in first out per device.

    Rename acks name no path. An ack that finds nothing waiting is lost: it is one that takes the
    count of renames minus acks below its lowest value so far.
    """
    key = ["vault", "device"]
    r = renames.select(*key, "event_id", "ts_ms", "old_path", "path", F.lit(0).alias("role"))
    a = acks.select(*key, "event_id", "ts_ms", F.lit(None).cast("string").alias("old_path"),
                    F.lit(None).cast("string").alias("path"), F.lit(1).alias("role"))
    is_ack = F.col("role") == 1
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    part = [*key, "_b"]
    inside = Window.partitionBy(*part).orderBy("ts_ms", "role", "event_id")
    here, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    line = (
        r.unionByName(a)
        .withColumn("_b", time_bucket(F.col("ts_ms"), bucket_ms))
        .withColumn("_r", F.sum(F.when(is_ack, zero).otherwise(one)).over(inside.rowsBetween(*here)))
        .withColumn("_a", F.sum(F.when(is_ack, one).otherwise(zero)).over(inside.rowsBetween(*here)))
        .withColumn("_low", F.min(F.col("_r") - F.col("_a")).over(inside.rowsBetween(*before)))
    )
    # what a bucket adds, and its lowest point; then the same over the buckets before
    along = Window.partitionBy(*key).orderBy("_b").rowsBetween(*before)
    carried = (
        line.groupBy(*part)
        .agg(F.max("_r").alias("_dr"), F.max("_a").alias("_da"), F.min(F.col("_r") - F.col("_a")).alias("_dlow"))
        .withColumn("_cr", F.coalesce(F.sum("_dr").over(along), zero))
        .withColumn("_ca", F.coalesce(F.sum("_da").over(along), zero))
        .withColumn("_clow", F.min(F.col("_cr") - F.col("_ca") + F.col("_dlow")).over(along))
        .select(*part, "_cr", "_ca", "_clow")
    )
    line = line.join(carried, part)
    lowest = F.least(zero, F.col("_clow"), F.col("_cr") - F.col("_ca") + F.col("_low"))  # nulls are skipped
    line = line.select(
        *key, "event_id", "ts_ms", "old_path", "path", "role", lowest.alias("_lowest"),
        (F.col("_cr") + F.col("_r")).alias("n_renames"), (F.col("_ca") + F.col("_a")).alias("n_acks"),
    )
    hit = is_ack & (F.col("n_renames") - F.col("n_acks") >= F.col("_lowest"))
    # the nth rename and the nth ack that found one meet under their number
    nth = F.when(is_ack, F.col("n_acks") + F.col("_lowest")).otherwise(F.col("n_renames"))
    rename = F.struct("event_id", "ts_ms", "old_path", "path")
    pairs = (
        line.filter(~is_ack | hit)
        .groupBy(*key, nth.alias("nth"))
        .agg(F.max(F.when(~is_ack, rename)).alias("_r"), F.max(F.when(is_ack, F.col("ts_ms"))).alias("acked_at"))
    )
    return pairs.filter(F.col("_r").isNotNull()).select(*key, "nth", "_r.*", "acked_at")


def drop_following(
    events: DataFrame, marks: DataFrame, window_ms: int, ops: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Events without those of ``ops`` that come at most ``window_ms`` after a mark with equal ``keys``.

    Time is cut in buckets as wide as the window. A mark in the bucket before counts when the latest
    is near enough, one in the same bucket when the earliest is not after the event; so two values
    per bucket decide, however many marks there are.
    """
    key = [*keys, "_b"]
    spans = marks.withColumn("_b", time_bucket(F.col("ts_ms"), window_ms)).groupBy(*key).agg(
        F.min("ts_ms").alias("_min"), F.max("ts_ms").alias("_max")
    )
    none = F.lit(None).cast("long")
    reach = F.array(
        F.struct(F.col("_b").alias("b"), F.col("_min").alias("lo"), none.alias("hi")),
        F.struct((F.col("_b") + 1).alias("b"), none.alias("lo"), F.col("_max").alias("hi")),
    )
    near = (
        spans.withColumn("_r", F.explode(reach))
        .withColumn("_b", F.col("_r.b"))
        .groupBy(*key)
        .agg(F.min("_r.lo").alias("_lo"), F.max("_r.hi").alias("_hi"))
    )
    echo = (F.col("_lo") <= F.col("ts_ms")) | (F.col("_hi") >= F.col("ts_ms") - window_ms)
    return (
        events.withColumn("_b", time_bucket(F.col("ts_ms"), window_ms))
        .join(near, key, "left")
        .filter(~(F.col("op").isin(list(ops)) & F.coalesce(echo, F.lit(False))))
        .select(*events.columns)
    )


def echo_window(local: DataFrame, remote: DataFrame, window_ms: int = ECHO_MS) -> DataFrame:
    """Local events without the deletes and renames that follow a remote apply of the same kind on
    the path within ``window_ms``."""
    return drop_following(local, remote, window_ms, ["delete", "rename"], [*STATE_KEY, "op"])


def drop_shadowed(events: DataFrame, delay_ms: int) -> DataFrame:
    """Events without the writes that come while a rename to their path still waits.

    A rename also shows as a write of the new path; the rename alone is sent. Apply this before
    debouncing, or the write takes the place of the rename.
    """
    if delay_ms <= 0:
        return events
    renames = events.filter(F.col("op") == "rename").select(*STATE_KEY, "ts_ms")
    return drop_following(events, renames, delay_ms, ["modify", "create"], STATE_KEY)
