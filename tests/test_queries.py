"""Every form query against its SQL in another engine."""

import duckdb
import pytest

from foliograph.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, float) and v != 0 else 0 if v == 0 and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, other, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    cur = other.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})")
    want = plain(cur.fetchall())
    assert len(got) == len(want) > 0
    assert got == want


@pytest.mark.parametrize("halved", [False, True])
def test_snapping_in_rows_and_relations(spark, halved):
    """On a page's own row, or all pages as relations: the same boxes and the same summary."""
    from foliograph.operators import matching as M
    from foliograph.plans import normalize as N
    from foliograph.sources import fixtures as X

    w, h = queries.W, queries.H
    fields, found = X.template_fields(spark, SF), X.detections(spark, SF, halved=halved)
    from pyspark.sql import functions as F

    rows = fields.orderBy("pos").collect()
    template = {"canvas": (w, h), "fields": [{"field_id": r.field_id, "field_type": r.field_type, "bbox": [r.x0, r.y0, r.x1, r.y1], "pad": r.pad} for r in rows]}
    boxes, summary = M.snap_overlay(fields, found, w, h)
    want = {(r.page, r.field_id): (r.x0, r.y0, r.x1, r.y1) for r in boxes.collect()}
    told = {r.page: r for r in summary.collect()}
    ordered = F.array_sort(F.collect_list(F.struct("idx", "x0", "y0", "x1", "y1")))
    pages = found.groupBy("page").agg(F.transform(ordered, lambda b: F.struct(*[b[n].alias(n) for n in ("x0", "y0", "x1", "y1")])).alias("boxes"))
    got = pages.select("page", N._snapped(F.col("boxes"), template).alias("s")).collect()
    assert {r.page for r in got} == set(told)
    for page, s in got:
        r = told[page]
        for f in s.fields:
            assert want[page, f.field_id] == pytest.approx((f.x0, f.y0, f.x1, f.y1), abs=1e-12)
        assert (r.n_detected, r.n_snapped, r.n_offset_hits) == (s.n_detected, s.n_snapped, s.n_offset_hits)
        assert (r.dx, r.dy) == pytest.approx((s.dx, s.dy), abs=0.011)


def test_kernels(spark):
    assert queries.QUERIES["clahe_tile"](spark, SF).count() >= 1


def test_stream(spark, tmp_path):
    from foliograph.sources import drawn, forms
    from foliograph.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(forms.png(drawn.photograph(drawn.form(drawn.template()))))
    (tmp_path / "in" / "bad.png").write_bytes(b"x")
    q = ingest.normalize_stream(spark, str(tmp_path / "in"), [drawn.template()], str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    assert [r.document_id for r in spark.read.parquet(str(tmp_path / "out" / "documents")).select("document_id").collect()] == ["one"]
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "crops")).count() == 133
