"""Archives: repeated ids with different payloads."""

from foliograph.llm import warc


def test_each_row_refers_by_its_own_payload(spark, tmp_path):
    html = [(1, "a"), (2, "b"), (3, "a"), (3, "own"), (4, "a"), (4, "b"), (5, "own")]
    df = spark.createDataFrame([(i, "u", h) for i, h in html], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    first = {"a": 1, "b": 2, "own": 3}
    want = [(i, warc.sha1_32(h.encode()), None if first[h] == i else first[h], h.encode() if first[h] == i else None) for i, h in html]
    assert sorted([(r.page_id, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in got], key=repr) == sorted(want, key=repr)
    assert len({r.record_id for r in got}) == len(html)
    held = {r.record_id: r.payload_digest for r in got if r.record_type == "response"}
    for r in got:
        if r.record_type == "revisit":
            assert held[warc.record_uuid("record", r.refers_to, r.payload_digest)] == r.payload_digest
