"""Requests of many items: messages of bounded size, rows that carry no message."""

import re

from driftline.sources import rounds, wire

ITEMS = "seq long, kind string, vault string, last_time long, context string, state string, path string, path_hash string, content_hash string, mtime long, ctime long, size long"


def test_large_requests_go_out_in_several_messages(spark):
    rows = [(i % 2, "note", None if i % 2 else "v", 5, "c", rounds.STATES[i % 3], f"p{i // 2}", "h", None, i, 1, 2) for i in range(2000)]
    rows += [(9, "file", "v", 5, "c", "present", "few", "h", "x", 1, 1, 1)] * 3
    items = spark.createDataFrame(rows, ITEMS)
    sent = rounds.encode_requests(items, 100)
    n = sorted((r.seq, r.body.count('"path":')) for r in sent.collect())
    assert len(n) == 21 and n[-1] == (9, 3) and max(k for _, k in n) < 200
    good, _ = wire.decode_messages(sent.select("seq", "raw"))
    back = rounds.request_items(good)
    assert sorted(map(str, back.collect())) == sorted(map(str, items.select(*back.columns).collect()))
    # the rows of the list carry facts of the message, not the message
    carried = re.search(r"Generate explode\(.*?\), \[(.*?)\]", back._jdf.queryExecution().sparkPlan().toString()).group(1)
    assert [c.split("#")[0] for c in carried.split(", ")] == ["seq", "kind", "vault", "last_time", "context"]
