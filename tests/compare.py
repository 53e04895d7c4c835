"""Rows of a query against rows of its SQL."""

import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def plain(x):
        if isinstance(x, float):
            return repr(round(x, 9))
        return repr(list(x)) if hasattr(x, "tolist") and not hasattr(x, "item") else str(x)

    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False))
