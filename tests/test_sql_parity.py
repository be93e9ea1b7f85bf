"""Queries against their SQL on tables made to part them."""

import duckdb

from plumbline import queries


def compared(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables, sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.toPandas().to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect())), sorted(con.execute(queries.SQL[name]).fetchall())


def test_scores_at_half_a_digit_are_those_of_sql(spark, tmp_path):
    """57, 69 and 113 of 800 words are distinct: decimal halves, whose products with 10^4 lie below a half."""
    texts = [" ".join(f"w{i % n}" for i in range(800)) for n in (57, 69, 113, 400)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality long, toxic long")
    got, want = compared(spark, tmp_path, "threshold_curve", documents=docs, labels=labels)
    assert [r[0] for r in got] == [0.0712, 0.0862, 0.1412, 0.5]
    assert got == want
