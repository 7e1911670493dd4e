"""The decision for every path: client row, last acknowledged hash and server row side by side.

The order of the rules is in one ``when`` chain. Rules that the protocol states are marked so;
the others are this library's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.skew import join_facts
from driftline.schema import STATE_KEY

#: conflict strategies: newest mtime wins, merge when the client is newest, always merge
STRATEGIES = ("", "newTimeMerge", "ignoreTimeMerge")
KINDS = ("note", "file", "config", "folder")


def per_device(
    server: DataFrame, devices: DataFrame, marks: DataFrame | None = None, present: DataFrame | None = None
) -> DataFrame:
    """Server rows once per device of their vault.

    With ``marks`` (``vault, device, kind, last_time``), a device gets only rows that changed after its watermark, as a
    round asks for, and rows of the paths in ``present`` (``vault, device, path``), its own and those of
    its base. The result then grows with what is new and what is there, not with rows times devices. A device
    without a watermark of a kind gets all rows of it.
    """
    every = devices.select("vault", "device").distinct()
    if marks is None:
        return join_facts(server, every, ["vault"], ["path"], "inner")
    own = present.select(*STATE_KEY).distinct()
    known = own.join(server, ["vault", "path"]).select(*server.columns, "device")
    limit = marks.select("vault", "device", "kind", F.col("last_time").alias("_mark"))
    kinds = F.explode(F.array(*map(F.lit, KINDS)))
    facts = every.withColumn("kind", kinds).join(limit, ["vault", "device", "kind"], "left")
    facts = facts.select("vault", "device", "kind", F.coalesce("_mark", F.lit(-1)).alias("_mark"))
    fresh = join_facts(server, facts, ["vault", "kind"], ["path"], "inner").where("last_time > _mark").drop("_mark")
    return fresh.join(own, STATE_KEY, "left_anti").select(*server.columns, "device").unionByName(known)


def reconcile(
    client: DataFrame,
    base: DataFrame,
    server: DataFrame,
    strategy: str = "",
    deleted: DataFrame | None = None,
    cover: bool = False,
) -> DataFrame:
    """One row per (vault, device, path) of client or server, with ``outcome`` and ``is_conflict``.

    ``server`` has a ``device`` column (see :func:`per_device`). ``deleted`` lists the keys that
    the client reports as deleted. ``cover`` lets the server win for config files. ``base_hash`` is
    filled where there is a client row.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    c = client.select(*STATE_KEY, F.struct("kind", "content_hash", "mtime").alias("c"))
    s = server.select(*STATE_KEY, F.struct("kind", "content_hash", "mtime", "is_deleted").alias("s"))
    b = base.select(*STATE_KEY, F.col("hash").alias("base_hash"))
    # The base matters only beside a client row, the delete list only beside a server row. Joining each to
    # its own side first keeps all inputs on one partitioning: every table is shuffled once.
    c = c.join(b, STATE_KEY, "left")
    if deleted is not None:
        s = s.join(deleted.select(*STATE_KEY).distinct().withColumn("_gone", F.lit(True)), STATE_KEY, "left")
    else:
        s = s.withColumn("_gone", F.lit(None).cast("boolean"))
    rows = c.join(s, STATE_KEY, "full_outer")

    ch, sh, bh = F.col("c.content_hash"), F.col("s.content_hash"), F.col("base_hash")
    cm, sm = F.col("c.mtime"), F.col("s.mtime")
    no_c, no_s = F.col("c").isNull(), F.col("s").isNull()
    s_gone = F.coalesce(F.col("s.is_deleted"), F.lit(False))
    kind = F.coalesce(F.col("c.kind"), F.col("s.kind"))
    base_is_c, base_is_s = F.coalesce(bh == ch, F.lit(False)), F.coalesce(bh == sh, F.lit(False))
    client_newest = cm > sm
    if strategy == "":
        both = F.when(client_newest, "NeedPush").otherwise("Modify")
    elif strategy == "newTimeMerge":
        both = F.when(client_newest, "Merge").otherwise("Modify")
    else:
        both = F.lit("Merge")

    outcome = (
        F.when(s_gone & no_c, "None")
        .when(s_gone & base_is_c, "Delete")  # stated: deleted on the server, unchanged here
        .when(s_gone, "NeedPush")
        .when(no_s, "NeedPush")  # stated: new here
        .when(no_c & F.col("_gone").isNotNull(), "ServerDelete")
        .when(no_c, "Modify")
        .when(F.lit(cover) & (kind == "config"), "Modify")  # stated: first config round
        .when((ch == sh) & (cm == sm), "None")
        .when(ch == sh, "Mtime")  # stated: same content, other time
        .when(base_is_c, "Modify")  # stated: the server is newer
        .when(base_is_s, "NeedPush")
        .otherwise(both)
    )
    plain = s_gone | no_s | no_c | (F.lit(cover) & (kind == "config")) | (ch == sh) | base_is_c | base_is_s
    return rows.select(
        *STATE_KEY, kind.alias("kind"), outcome.alias("outcome"), (~plain).alias("is_conflict"),
        ch.alias("client_hash"), sh.alias("server_hash"), "base_hash",
    )
