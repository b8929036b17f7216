"""morph_close: the same as its SQL on odd rows, with each pixel shuffled once."""

import duckdb

from foliograph.plans import queries as Q


def test_odd_rows_and_one_shuffle(spark, tmp_path):
    rows = [(k, [float((7 * k * (i + 3)) % 13 - 6) / 10 for i in range(64)]) for k in range(20)]
    rows += [(3, [0.5 - i / 70 for i in range(64)]), (4, [0.1] * 11), (50, [0.3, None, -0.2, 0.9] * 5), (51, []), (52, None), (None, [0.2] * 64), (53, [i / 80 - 0.5 for i in range(77)])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.morph_close(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(Q.ORACLES["morph_close"]).fetchall()
    assert got.columns == ["vec_id", "y", "x", "v"] and [t for _, t in got.dtypes] == ["bigint", "int", "int", "int"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1
