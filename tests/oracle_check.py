"""Runs every query beside its SQL and compares them: python tests/oracle_check.py <folder> [names]"""

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, statement):
    """Empty text when both sides hold the same columns and the same bag of rows."""
    result = con.execute(statement)
    names = [c[0] for c in result.description]
    theirs = bag(result.fetchall(), names)
    ours = bag([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        return (
            f"rows {sum(ours.values())} / {sum(theirs.values())}, differing "
            f"{sum(extra.values())} / {sum(lacking.values())}\n  ours   "
            f"{[str(x)[:600] for x in list(extra)[:2]]}\n  theirs {[str(x)[:600] for x in list(lacking)[:2]]}"
        )
    return "" if ours else "no rows on either side"


def main():
    from tidewire.plans.oracle import SQL
    from tidewire.plans.queries import REGISTRY
    from tidewire.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), connect(folder)
    bad = 0
    for name, run in REGISTRY.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            text = compare(run(spark, folder), con, SQL[name]) if name in SQL else "no SQL"
        except Exception as error:
            text = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(text)
        print(f"{'FAIL' if text else 'ok'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
