"""Compare a query with its SQL on the small tables, as values of rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def canon(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else [canon(v) for v in value] if isinstance(value, (list, tuple)) else value


def agree(df, sql, sf_dir):
    names, want = rows_of(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [[r[n] for n in sorted(names)] for r in df.collect()]
    want = [[r[names.index(n)] for n in sorted(names)] for r in want]
    key = lambda r: repr([canon(v) for v in r])
    assert sorted(map(key, got)) == sorted(map(key, want))
