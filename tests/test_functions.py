"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import fingerprint, media, messages, paths, reports
from driftline.operators import filters, rules
from driftline.sources import listing, log_text, state_store, wire


def one(spark, fn, schema, *rows):
    return fn(spark.createDataFrame(list(rows), schema)).collect()


def rolling(units) -> str:
    h = 0
    for u in units:
        h = (h * 31 + u) & 0xFFFFFFFF
    return str(h - (1 << 32) if h >= 1 << 31 else h)


def utf16(text):
    raw = text.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


@pytest.mark.parametrize("path, want", [("a/b.md", "-1471566959"), ("测试哈哈2.md", "-1409532355"), ("", "0"), ("x😀y", "58534910")])
def test_path_hash_golden(spark, path, want):
    assert one(spark, fingerprint.fingerprint_paths, "path string", (path,))[0].path_hash == want
    assert rolling(utf16(path)) == want


def test_hash_of_null_is_null(spark):
    assert one(spark, fingerprint.fingerprint_paths, "path string", (None,))[0].path_hash is None


@pytest.mark.parametrize("size", [0, 1, 257, 10 * 1024 * 1024, 10 * 1024 * 1024 + 1, 11 * 1024 * 1024])
def test_binary_hash(spark, size):
    import numpy as np

    data = np.random.default_rng(size).integers(0, 256, size, dtype="uint8")
    mask = 0xFFFFFFFF
    powers = np.ones(65536, dtype=np.uint64)
    for j in range(65534, -1, -1):
        powers[j] = int(powers[j + 1]) * 31 & mask

    def plain(seen):
        h = 0
        for i in range(0, len(seen), 65536):  # block form of the recurrence
            block = seen[i : i + 65536].astype(np.uint64)
            tail = powers[-len(block) :]
            h = (h * (int(tail[0]) * 31 & mask) + int((block * tail & np.uint64(mask)).sum())) & mask
        return str(h - (1 << 32) if h >= 1 << 31 else h)

    sampled = data if size <= 10 * 1024 * 1024 else np.concatenate([data[: 5 * 1024 * 1024], data[-5 * 1024 * 1024 :]])
    row = spark.createDataFrame([(bytearray(data.tobytes()),)], "content binary")
    got = fingerprint.fingerprint_binary(row).select("content_hash", fingerprint.wire_fingerprint(F.col("content")).alias("wire")).first()
    assert got.content_hash == plain(data) and got.wire == plain(sampled)


def test_an_edit_in_the_middle_of_a_large_file_shows(spark):
    size = 12 * 1024 * 1024
    rows = [(bytearray(size),), (bytearray(size // 2) + b"x" + bytearray(size - size // 2 - 1),)]
    got = fingerprint.fingerprint_binary(spark.createDataFrame(rows, "content binary")).select("content_hash").collect()
    assert got[0] != got[1]


@pytest.mark.parametrize(
    "size, want",
    [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1025, "1 KB"), (1100, "1.07 KB"),
     (1048575, "1024 KB"), (1048576, "1 MB"), (5 * 1024**3 + 1024**2 * 51, "5.05 GB"), (1024**6, "1 EB"), (None, "0 B")],
)
def test_size_text(spark, size, want):
    assert one(spark, reports.size_report, "size long", (size,))[0].size_text == want


def test_enrich_paths_quirks(spark):
    rows = {r.path: r for r in one(spark, paths.enrich_paths, "path string", ("a/b/c.tar.GZ",), ("dir.x/noext",), ("top.md",), ("w\\x\\y.md",), ("a/.hidden",), ("a/b/",))}
    r = rows["a/b/c.tar.GZ"]
    assert (r.name, r.stem, r.top, r.ext, r.kind, r.parent, r.depth) == ("c.tar.GZ", "c.tar", "a", ".gz", "file", "a/b", 3)
    assert (rows["dir.x/noext"].name, rows["dir.x/noext"].ext) == ("", ".x/noext")
    assert (rows["top.md"].top, rows["top.md"].parent, rows["top.md"].kind) == ("", "", "note")
    assert (rows["w\\x\\y.md"].name, rows["w\\x\\y.md"].top) == ("y.md", "w\\x\\y.md")
    assert (rows["a/.hidden"].name, rows["a/.hidden"].stem) == (".hidden", "")
    assert rows["a/b/"].name == ""


def test_sanitize(spark):
    got = one(spark, paths.sanitize_paths, "path string", ('a\\b:c*/d?"<>|e/',), ("",), (None,))
    assert [r.clean_path for r in got] == ["a/b-c-/d-----e/", "", None]


def test_auth_report_golden(spark):
    plain = one(spark, reports.auth_error_report, "code int, message string, details string", (308, None, None), (315, None, "Permission denied: Handshake"))
    assert "Code=308" in plain[0].report and "Session expired or token has been revoked" in plain[0].report
    assert "Please re-import the API configuration" in plain[0].report
    assert "Authorization token scope is restricted" in plain[1].report
    assert "Details=Permission denied: Handshake" in plain[1].report and "re-import" not in plain[1].report
    listed = one(spark, reports.auth_error_report, "code int, message string, details array<string>", (308, None, ["Token has been rotated"]), (316, "x", [" a ", None, "", "b"]), (316, None, None))
    assert "Details=Token has been rotated" in listed[0].report and "re-import" in listed[0].report
    assert listed[1].report == "Service Authorization Error: Code=316 Msg=x Details=a, b"
    assert listed[2].report == "Service Authorization Error: Code=316 Msg=Authorization failed"
    assert not any("undefined" in r.report for r in plain + listed)


@pytest.mark.parametrize(
    "current, latest, want",
    [("1.2", "1.2.0", False), ("1.2", "1.10", True), ("1.10.0", "1.9", False), ("1.2.0-alpha", "1.2.0", False), ("", "1.0", False),
     ("1.0", "", False), (None, "1", False), ("v1.0", "0.5", True), ("1", "1.0.0.1", True)],
)
def test_version(spark, current, latest, want):
    assert one(spark, reports.version_report, "current string, latest string", (current, latest))[0].is_new is want


def test_media(spark):
    got = one(spark, media.classify_media, "path string", ("a.OGG",), ("a.m4a",), ("a.wximage",), ("a",), ("x.pdf",))
    assert [r.media for r in got] == ["video", "audio", "image", "other", "pdf"]
    secs = one(spark, media.media_offset, "subpath string", ("#t=30",), ("#t=1.5,9",), ("#t=",), ("#page=2",), (None,))
    assert [r.offset_seconds for r in secs] == [30.0, 1.5, None, None, None]


def test_url_rules_and_restriction(spark):
    rules_ = media.parse_url_rules("A/@.PNG$.jpg#https://x/{path}\n@.md#u\nno mark\n.pdf#\n")
    assert [(r.prefix, r.exts, r.url) for r in rules_] == [("a/", (".png", ".jpg"), "https://x/{path}"), ("", (".md",), "u")]
    df = spark.createDataFrame([("v v", "A/p q.png", None), ("v", "z.zip", None), ("v", "noext", None)], "vault string, path string, subpath string")
    got = [r.url for r in media.resolve_urls(df, "", "http://h", "t", "c", restricted=True).collect()]
    assert got[0].startswith("http://h/api/file?vault=v+v&path=A%2Fp+q.png&token=t&pathHash=") and got[1:] == [None, None]


def test_parse_rules():
    R = rules.Rule
    assert rules.parse_rules('["a", {"pattern": "b", "caseSensitive": true}, {"x": 1}, ""]') == [R("a"), R("b", True)]
    assert rules.parse_rules("[a\n\n b \r\nc]") == [R("[a"), R("b"), R("c]")]
    assert rules.parse_rules("  ") == [] and rules.parse_rules("[]") == [] and rules.parse_rules(None) == []
    assert rules.parse_rules(rules.write_rules([R("q", True)])) == [R("q", True)] and rules.write_rules([]) == ""
    assert rules.custom_dirs('["x//", "/", "y"]') == ["x", "y"]


def test_match_rules_quirks(spark):
    df = spark.createDataFrame([("Src/a.md",), ("deep/b/x",), ("(((/x",), ("aXb",), ("a\\c\\d",), ("cc",)], "path string")

    def hits(pattern, sensitive=False):
        checked = rules.check_rules(spark, [rules.Rule(pattern, sensitive)])
        return [r.path for r in rules.match_rules(df, checked).filter("matched").collect()]

    assert hits("src") == ["Src/a.md"] and hits("src", True) == []
    assert hits("zz|b") == ["deep/b/x", "aXb"]  # only the first branch is anchored
    assert hits("(((") == ["(((/x"]  # no valid expression: prefix only
    assert hits("a/c") == ["a\\c\\d"]  # slashes are equal in the prefix match
    assert hits(r"(.)\1") == ["(((/x", "cc"]  # a pattern that refers to its own group


def test_size_guard_edges(spark):
    mib = 1024 * 1024
    df = spark.createDataFrame(
        [("note", 20 * mib), ("note", 20 * mib + 1), ("file", 50 * mib), ("file", 50 * mib + 1), ("config", 128 * mib), ("config", 128 * mib + 1), ("folder", None)],
        "kind string, size long",
    )
    kept, dropped = filters.size_guard(df)
    assert kept.count() == 4 and {(r.kind, r.size % 2) for r in dropped.collect()} == {("note", 1), ("file", 1), ("config", 1)}
    assert filters.size_guard(df, binary_limit=False)[1].filter("kind = 'config'").count() == 0


def test_log_lines(spark):
    df = spark.createDataFrame(
        [("a", 1, 1704067200123, "send", "note", "success", "NoteModify", "n.md", "two\nlines"),
         ("b", 2, 1704067200000, "info", "summary", "success", "SyncSummary", None, '{"syncType":"full","note":{"upload":1,"modify":2,"delete":3},"config":{"upload":0,"modify":0,"delete":0}}'),
         ("c", 3, 1704067200000, "info", "summary", "error", "SyncSummary", None, "{broken"),
         ("d", 4, 1704067200000, "receive", "other", "success", "AnActionWithAVeryLongNameIndeed", "", "")],
        "id string, first_seq long, timestamp long, type string, category string, status string, action string, path string, message string",
    )
    lines = [r.line for r in log_text.log_lines(df).orderBy("first_seq").collect()]
    assert lines[0] == "[2024-01-01 00:00:00] [SEND   ] [NOTE        ] [SUCCESS ] NoteModify                [Path: n.md] [Msg: two lines]"
    assert lines[1].endswith("SyncSummary               [Msg: Sync completed (Full): Note(up:1,recv:2,del:3), Config(up:0,recv:0,del:0)]")
    assert lines[2].endswith("[Msg: {broken]")
    assert lines[3].endswith("] AnActionWithAVeryLongNameIndeed")


def test_write_log_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"i{i}", i, 1704067200000, "send", "note", "pending" if i == 3 else "success", "NoteModify", None, None) for i in range(5)],
        "id string, first_seq long, timestamp long, type string, category string, status string, action string, path string, message string",
    )
    log_text.write_log_text(df, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def test_messages_split(spark):
    df = spark.createDataFrame([('A|{"x":"p|q"}',), ('{"y":1}',), ("B|{",), ("|1",)], "raw string")
    good, bad = wire.decode_messages(df)
    assert [(r.action, r.body) for r in good.collect()] == [("A", '{"x":"p|q"}'), ("", '{"y":1}'), ("", "1")]
    assert [r.action for r in bad.collect()] == ["B"]
    typed = wire.decode_action(good, "A", "x string").collect()
    assert typed[0].data.x == "p|q"


def test_chunk_round_trip(spark):
    from driftline.operators import chunks

    bodies = {"e" * 36: b"", "f" * 36: bytes(range(256)) * 5, "0" * 36: b"x"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "session_id string, content binary")
    frames = wire.encode_chunks(files, 100)
    assert frames.count() == 1 + 13 + 1
    got = wire.decode_chunks(frames).withColumn("seq", F.col("chunk_index"))
    sessions = spark.createDataFrame([(k, len(v), max(1, -(-len(v) // 100))) for k, v in bodies.items()], "session_id string, size long, total_chunks long")
    back = {r.session_id: r for r in chunks.assemble_files(got, sessions).collect()}
    assert {k: bytes(r.content) for k, r in back.items()} == bodies and all(r.error is None for r in back.values())
    tiny = chunks.assemble_files(got, sessions, limit=10).filter("session_id like 'f%'").collect()[0]
    assert tiny.error == "too large" and tiny.content is None
    pieces = sorted(chunks.ordered_pieces(got, sessions).filter("session_id like 'f%'").collect(), key=lambda r: r.offset)
    assert b"".join(bytes(r.payload) for r in pieces) == bodies["f" * 36] and [r.offset for r in pieces] == [100 * i for i in range(13)]
    assert wire.decode_chunks(spark.createDataFrame([(bytearray(39),), (bytearray(40),)], "frame binary")).count() == 1


def test_last_copy_of_a_chunk_wins(spark):
    from driftline.operators import chunks

    rows = spark.createDataFrame([("s", 0, bytearray(b"old"), 1), ("s", 0, bytearray(b"new"), 5), ("s", 2, bytearray(b"x"), 2)], "session_id string, chunk_index long, payload binary, seq long")
    two = spark.createDataFrame([("s", 3, 1)], "session_id string, size long, total_chunks long")
    assert chunks.assemble_files(rows, two).collect()[0].error == "invalid chunk index"
    got = chunks.assemble_files(rows.filter("chunk_index = 0"), two).collect()[0]
    assert bytes(got.content) == b"new"


def test_virtual_entries_use_utf16_length(spark):
    kv = spark.createDataFrame([("v", "d", "k", "a😀", None), ("v", "d", "n", None, 5)], "vault string, device string, key string, value string, mtime long")
    rows = listing.virtual_entries(kv, 77).collect()
    assert [(r.path, r.size, r.mtime, r.ctime) for r in rows] == [("_localStorage/k", 3, 77, 77)]


def test_vault_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "n.md").write_text("hi")
    (tmp_path / "p.png").write_bytes(b"123")
    scan = listing.vault_scan(spark, str(tmp_path), "v", "d")
    rows = {r.path: (r.kind, r.size) for r in scan.collect()}
    assert rows == {"a/b/n.md": ("note", 2), "p.png": ("file", 3), "a": ("folder", None), "a/b": ("folder", None)}
    (tmp_path / ".conf").mkdir()
    (tmp_path / ".conf" / "app.json").write_text("{}")
    both = {r.path for r in listing.vault_scan(spark, str(tmp_path), "v", "d", hidden=[".conf"]).collect()}
    assert both == set(rows) | {".conf", ".conf/app.json"}
    for path in ("a/_att/p.png", "a/.h/d.md", "_x/e f%20g.md", ".conf/plugins/x/main.js"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    want = {(str(p.relative_to(tmp_path)), p.is_dir(), None if p.is_dir() else p.stat().st_size, None if p.is_dir() else p.stat().st_mtime_ns // 10**6) for p in tmp_path.rglob("*")}
    found = listing.vault_scan(spark, str(tmp_path), "v", "d", hidden=[".conf"]).collect()
    assert {(r.path, r.kind == "folder", r.size, r.mtime) for r in found} == want and len(found) == len(want)
    assert {r.path for r in found if r.kind == "config"} == {".conf/app.json", ".conf/plugins/x/main.js"}


def test_vault_scan_of_a_flat_and_a_deep_folder(spark, tmp_path, monkeypatch):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(700):
        (flat / f"n{i}.md").write_bytes(b"x" * (i % 7))
    deep = tmp_path
    for i in range(6):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / "f.png").write_bytes(b"12")
    (tmp_path / "link").symlink_to(tmp_path / "d0", target_is_directory=True)  # a loop if it were followed
    monkeypatch.setattr(listing, "FACTS", 100)
    monkeypatch.setattr(listing, "NAMES", 64)
    found = listing.entries(spark, f"file:{tmp_path}")
    rows = {r.path: (r.is_folder, r.size) for r in found.collect()}
    want = {f"flat/n{i}.md": (False, i % 7) for i in range(700)} | {"flat": (True, None)}
    for i in range(6):
        place = "/".join(f"d{j}" for j in range(i + 1))
        want |= {place: (True, None), f"{place}/f.png": (False, 2)}
    assert {p: v for p, v in rows.items() if p != "link"} == want
    assert found.filter("path LIKE 'flat/%'").select(F.spark_partition_id()).distinct().count() > 4  # one folder, many tasks
    assert listing.vault_scan(spark, str(tmp_path / "none"), "v", "d").count() == 0
    inventory = found.filter("NOT is_folder AND path <> 'link'").select("path", "mtime", "size")
    both = [listing.vault_scan(spark, str(tmp_path), "v", "d", ["d0"], i).filter("path <> 'link'") for i in (None, inventory)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_state_maps_old_and_new_form(spark, tmp_path):
    maps = spark.createDataFrame([("v", "d", '{"a.md":"77","b/\\"c.md":{"hash":"-5","mtime":9,"size":3},"z":{"hash":"1"}}')], "vault string, device string, json string")
    rows = {r.path: (r.hash, r.mtime, r.size) for r in state_store.load_state(maps).collect()}
    assert rows == {"a.md": ("77", 0, 0), 'b/"c.md': ("-5", 9, 3), "z": ("1", 0, 0)}
    state = state_store.load_state(maps)
    again = state_store.load_state(state_store.state_maps(state, per_map=1)).drop("shard")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect()))
    state_store.store_state(state, str(tmp_path / "s"))
    kept = state_store.read_state(spark, str(tmp_path / "s")).select(*state.columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, state.collect()))
    folders = spark.createDataFrame([("v", '{"a":5,"a/b":7}')], "vault string, json string")
    assert {(r.path, r.mtime) for r in state_store.load_folder_state(folders).collect()} == {("a", 5), ("a/b", 7)}


def test_status_of_messages(spark):
    rows = [("receive", "FileUpload", 200, "s"), ("receive", "FileUpload", None, "s"), ("receive", "NoteModify", 1, "s"), ("receive", "X", 201, "s"),
            ("receive", "X", 0, None), ("receive", "X", None, None), ("receive", "X", -3, None), ("send", "FileDownload", None, "s"), ("send", "X", 0, None)]
    got = one(spark, messages.message_status, "direction string, action string, code long, session_id string", *rows)
    assert [r.status for r in got] == ["pending", "pending", "success", "error", "error", "success", "success", "pending", "success"]
