"""Answers by their place in a batch."""

from wardline.operators import advisories


def test_zip(spark):
    asked = spark.createDataFrame([(b, i, f"p{i}", "1") for b, n in (("a", 3), ("b", 1), ("c", 1), ("d", 1), ("e", 2)) for i in range(n)], "batch string, pos int, name string, version string")
    bodies = [("a", '{"results": [{"vulns": [{"id": "X-1"}, {"id": "../up"}, {"no": 1}]}, {}, {"vulns": [{"id": "Y:2"}]}]}'), ("b", '{"results": []}'), ("c", "broken"), ("e", '{"results": [{}, {}]}'), ("e", '{"results": [{}, {}]}'), ("z", '{"results": [{}]}')]
    found, failed = advisories.zip_answers(asked, spark.createDataFrame(bodies, "batch string, body string"))
    assert sorted((r.batch, r.pos, r.name, r.id) for r in found.collect()) == [("a", 0, "p0", "X-1"), ("a", 2, "p2", "Y:2")]
    assert sorted((r.batch, r.asked, r.got) for r in failed.collect()) == [("b", 1, 0), ("c", 1, -1), ("d", 1, -1), ("e", 2, -1)]
