"""Compare registered queries with their SQL: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_with_views(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda row: [(v is None, str(v)) for v in row]
    )


def difference(spark_df, relation) -> str | None:
    names = relation.columns
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    left = sorted_rows(spark_df.columns, spark_df.collect())
    right = sorted_rows(names, relation.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for one, two in zip(left, right):
        if one != two or [type(v) for v in one] != [type(v) for v in two]:
            return f"\n  spark {str(one)[:700]}\n  sql   {str(two)[:700]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = make_session()
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            if name in sql:
                result = difference(query(spark, sf_dir), duckdb_with_views(sf_dir).sql(sql[name]))
            else:
                query(spark, sf_dir).collect()
                result = None
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{name:22s} {time.time() - started:6.1f}s {result or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
