from pyspark.sql import functions as F

from driftwell.functions import labels as B


def test_spread_keeps_labels_apart():
    assert B.spread([0.5, 0.5, 0.51], 0.1, 0, 1) == [0.5, 0.6, 0.7]
    top = B.spread([0.95, 0.98, 0.99], 0.1, 0, 1)
    assert max(top) <= 1 and all(b - a >= 0.1 - 1e-12 for a, b in zip(sorted(top), sorted(top)[1:]))
    assert B.spread([], 0.1, 0, 1) == []


def test_schema_keywords_go_at_any_depth():
    schema = {"type": "object", "title": "x", "properties": {"title": {"type": "string", "minLength": 1}}, "anyOf": [{"title": "y"}]}
    assert B.without_keywords(schema, ["title", "minLength"]) == {"type": "object", "properties": {"title": {"type": "string"}}, "anyOf": [{}]}


def test_band_keeps_nan(spark):
    low, high = B.band(F.col("m"), F.col("s"))
    rows = spark.createDataFrame([(0.9, 0.3), (float("nan"), 0.1)], "m double, s double").select(low.alias("l"), high.alias("h")).collect()
    assert (round(rows[0].l, 9), rows[0].h) == (0.6, 1.0) and rows[1].l != rows[1].l
