"""Compare a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows(data, columns):
    order = sorted(columns)
    return sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in data)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(got, df.columns) == rows(want, names)
    return len(got)
