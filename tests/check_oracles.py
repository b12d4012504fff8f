"""Run every registered query beside its DuckDB answer and report differences.

    python tests/check_oracles.py [data folder] [query name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def multiset(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    table = df.toArrow()
    took = time.time() - start
    if sql is None:
        return False, f"{table.num_rows} rows, no oracle, {took:.1f}s"
    got = multiset(table.column_names, zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else Counter()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = multiset(names, cur.fetchall())
    if sorted(names) != sorted(table.column_names):
        return False, f"columns {sorted(table.column_names)} against {sorted(names)}"
    if got != want:
        return False, (f"{table.num_rows} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}; "
                       f"only there {list((want - got).items())[:2]}")
    return True, f"{table.num_rows} rows, {took:.1f}s"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from vigil.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = local_session(8), duck(sf_dir)
    answers, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note = compare(spark, con, name, fn, answers.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
