"""Comparison of a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, run, sql, sf, tmp_path):
    run(spark, sf).write.parquet(str(tmp_path / "got"))
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    d.execute(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    d.execute(f"CREATE TABLE want AS {sql}")
    got = sorted(r[:2] for r in d.sql("DESCRIBE got").fetchall())
    assert got == sorted(r[:2] for r in d.sql("DESCRIBE want").fetchall())
    columns = ", ".join(f'"{c}"' for c, _ in got)
    for a, b in (("got", "want"), ("want", "got")):
        assert d.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
