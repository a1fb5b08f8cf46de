"""Results of Spark and DuckDB as comparable multisets."""

import os
from collections import Counter

import duckdb


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if v != v else float(f"{float(v):.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def database(folder):
    db = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return db


def assert_same(frame, db, sql):
    columns = sorted(frame.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in places) for row in got.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
