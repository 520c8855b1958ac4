"""Compare queries with their SQL twins: ``python tests/oracle.py SF_DIR [name…]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    # spill outside the repository
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='run-')}'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool):
        return bool(v)
    if hasattr(v, "quantize"):
        return float(v)
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{took:6.1f}s rows={len(got)} (rows only)"
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(want_columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} want {sorted(want_columns)}"
    kinds = {c: _KINDS.get(t, t) for c, t in df.dtypes}
    off = [f"{c}: {kinds[c]} want {want_types[c]}" for c in df.columns if kinds[c] != want_types[c]]
    a, b = _rows(df.columns, got), _rows(want_columns, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"rows {len(a)} want {len(b)}; first differences {diff}"
    note = f" TYPES {off}" if off else ""
    return not off, f"{took:6.1f}s rows={len(a)}{note}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from unitscope.session import get_session

    sf, wanted = argv[0], argv[1:]
    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
