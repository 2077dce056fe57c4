import json

from pyspark.sql import functions as F

from lodestone.functions.text import cache_key
from lodestone.plans import pipelines


def test_generate_with_a_stored_response_and_without(spark):
    c = spark.createDataFrame([("n1", "OrderService"), ("n2", "test_x")], "node_id string, name string")
    m = spark.createDataFrame([("n1", 0.5), ("n2", 0.1)], "node_id string, pagerank double")
    known = spark.createDataFrame([("obj", "DataObject")], "identifier string, element_type string")
    empty = spark.createDataFrame([], "cache_key string, content string")
    args = (["service"], ["test"], known, "List.", "m")
    first = pipelines.generate(c, m, empty, "ApplicationService", *args)
    assert first["elements"].collect() == [] and first["missing"].count() == 1
    prompt = first["missing"].first().prompt
    answer = json.dumps({"elements": [{"identifier": "Order Service", "name": "Orders", "source": "n1"}], "relationships": [{"source": "order_service", "target": "obj", "relationship_type": "Access"}, {"source": "order_service", "target": "obj", "relationship_type": "Flow"}]})
    table = spark.createDataFrame([(prompt, answer)], "prompt string, content string").select(cache_key(F.col("prompt"), F.lit("m")).alias("cache_key"), "content")
    second = pipelines.generate(c, m, table, "ApplicationService", *args)
    assert [r.identifier for r in second["elements"].collect()] == ["order_service"]
    assert [r.relationship_type for r in second["relationships"].collect()] == ["Access"]
    assert second["missing"].count() == 0


def test_refine_fails_softly_and_patterns(spark):
    e = spark.createDataFrame([("a", "A", "Node", None, "r", True), ("b", "A", "Node", "doc", "r", True)], "identifier string, name string, element_type string, documentation string, repository_name string, enabled boolean")
    r = spark.createDataFrame([], "identifier string, source_id string, target_id string, relationship_type string")
    got = pipelines.refine("duplicate_elements", e, r)
    assert [tuple(x) for x in got["findings"].collect()] == [("a", "b")]
    assert not pipelines.refine("nothing", e, r)["success"]
    p = spark.createDataFrame([("s", "include", '["b", "a"]', True), ("s", "exclude", '["c"]', True), ("s", "include", '["z"]', False)], "step_name string, pattern_type string, patterns string, is_active boolean")
    assert pipelines.patterns(p, "s") == (["a", "b"], ["c"])


def test_enriched_nodes(spark):
    n = spark.createDataFrame([("a",), ("z",)], "node_id string")
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    got = {r.node_id: r.out_degree for r in pipelines.enrich(n, e, [("degree", {})]).collect()}
    assert got == {"a": 1, "z": None}
