"""Rows of a Spark query against those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def difference(df, con, sql):
    """'' where equal, else what differs."""
    found = con.sql(sql)
    names, want = list(found.columns), found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only Spark: {sorted(set(a) - set(b))[:3]}; only SQL: {sorted(set(b) - set(a))[:3]}"
