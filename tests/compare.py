"""Rows of a query and of its SQL, made comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows(found):
    return sorted(tuple(_cell(v) for v in row) for row in found)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    columns = sorted(df.columns)
    said = con.sql(sql)
    assert columns == sorted(said.columns)
    quoted = [f'"{c}"' for c in columns]
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(con.sql(f"select {', '.join(quoted)} from ({sql})").fetchall())
