"""Runs a query's oracle SQL in DuckDB and compares rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if os.path.exists(path.replace("/*.parquet", "")):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(repr([r[k] for k in order]) for r in found.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(repr([r[c] for c in names]) for r in df.collect())


def thue_morse(n):
    """Two different words of ``n`` (a power of two) letters that have equal polynomial hashes modulo 2**64."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
