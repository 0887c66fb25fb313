"""Compare a registered query with its SQL on DuckDB, as rows sorted by all columns."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        if type(x).__name__ == "Decimal":
            return round(float(x), 6)
        return x

    return sorted(([plain(r[c]) for c in columns] for r in frame), key=repr)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = [dict(zip(names, r, strict=True)) for r in con.fetchall()]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [r.asDict() for r in df.collect()]
    assert len(got) == len(want)
    columns = sorted(names)
    for g, w in zip(rows_of(got, columns), rows_of(want, columns), strict=True):
        for x, y in zip(g, w, strict=True):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), (g, w)
            else:
                assert x == y, (g, w)
    return len(got)
