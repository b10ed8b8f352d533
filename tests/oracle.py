"""Run queries against their SQL in DuckDB and compare them as multisets of rows."""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


TIMES = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, query, sql: str | None) -> str | None:
    """What differs, or None."""
    start = time.time()
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    TIMES["spark"] = time.time() - start
    if sql is None:
        return None if got else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    wanted = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if got != wanted:
        extra, lost = got - wanted, wanted - got
        return (f"{sum(got.values())} rows instead of {sum(wanted.values())};"
                f" extra {list(extra)[:2]} lost {list(lost)[:2]}")
    return None if got else "no rows"


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, connection = make_session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, query, oracles.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows only"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} ({kind},"
              f" {TIMES.get('spark', 0):.1f} of {time.time() - start:.1f} s) {problem or ''}"[:1500], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
