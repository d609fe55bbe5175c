"""Compares registered queries with their SQL on the same tables (also a command line tool)."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for col in frame.columns:
        if str(frame[col].dtype).startswith("datetime64"):
            frame = frame.assign(**{col: frame[col].astype("datetime64[us]")})
    rows = frame.astype(object).where(frame.notna(), None)
    text = rows.map(lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    differ = (a != b).any(axis=1)
    if differ.any():
        at = differ.idxmax()
        return f"{int(differ.sum())} rows differ, first:\n  {a.loc[at].to_dict()}\n  {b.loc[at].to_dict()}"
    return ""


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def types_differ(frame, answer) -> str:
    ours = {c: KINDS.get(t, t) for c, t in frame.dtypes}
    theirs = {c: str(t) for c, t in zip(answer.columns, answer.types)}
    return ", ".join(f"type of {c}: {ours[c]} vs {theirs[c]}" for c in ours if ours[c] != theirs[c])


def main() -> None:
    import __spark_entry__ as entry

    from wattfold.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = fn(spark, sf_dir)
            ours = frame.toPandas()
            took = time.time() - start
            result = "no sql"
            if name in sql:
                answer = con.sql(sql[name])
                result = compare(ours, answer.df()) or types_differ(frame, answer)
            rows = len(ours)
        except Exception as problem:  # report and go on with the next query
            result, took, rows = f"{type(problem).__name__}: {str(problem)[:700]}", time.time() - start, -1
        bad += result not in ("", "no sql")
        print(f"{'ok ' if not result else 'BAD' if result != 'no sql' else '-  '} {name} {rows} rows {took:.2f}s {result}", flush=True)
    print(f"{bad} bad of {len(entry.queries())}, without sql: {sorted(set(entry.queries()) - set(sql))}")


if __name__ == "__main__":
    main()
