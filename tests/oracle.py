"""Compare a Spark query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return tuple(map(_value, x)) if isinstance(x, list) else x


def rows(columns, data):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in by) for r in data), key=repr)


def compare(spark, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{sf_dir}/{x}.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns), name
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(expected), (name, len(got), len(expected))
    assert got == expected, (name, [x for x in zip(got, expected) if x[0] != x[1]][:3])
    return len(got)
