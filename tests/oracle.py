"""Compare registered queries with their SQL in DuckDB, row by row."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from driftline.plans.fixtures import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "binary": "BLOB", "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP",
}


def compare(spark, sf_dir: str, fn, sql: str, con=None) -> list[str]:
    """Differences as text; empty when equal."""
    con = con or duck(sf_dir)
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(dcols):
        return [f"columns {sorted(df.columns)} / {sorted(dcols)}"]
    for name, t in df.dtypes:
        if DUCK_TYPES.get(t, t) != dtypes[name]:
            problems.append(f"type of {name}: {t} / {dtypes[name]}")
    a, b = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(dcols, drows)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        problems.append(f"cols {sorted(dcols)}")
        problems += [f"spark only: {x[:300]}" for x in sorted(sa - sb)[:4]]
        problems += [f"sql only:   {x[:300]}" for x in sorted(sb - sa)[:4]]
    if not b:
        problems.append("no rows: the check proves nothing")
    return problems


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from driftline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    names = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in os_:
                out = compare(spark, sf, qs[n], os_[n], con)
                mark = "ok" if not out else "DIFF"
            else:
                out, mark = [], f"rows={qs[n](spark, sf).count()} (no sql)"
        except Exception as ex:  # noqa: BLE001
            out, mark = [str(ex)[:900]], "ERROR"
        bad += bool(out)
        print(f"{n:34s} {mark} {time.time() - t:.1f}s", flush=True)
        for line in out:
            print("     ", line, flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
