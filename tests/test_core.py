import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalogue, chunks, classify, consistency, extract, model, numbering, ranking, responses, versioning
from lodestone.sources import eventlog, files


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_percentiles(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 2.0), ("D", 3.0)], "k string, v double")
    mean = {r.k: r.percentile for r in numbering.percentiles_by_mean_rank(df, "v").collect()}
    assert mean == {"A": 16.67, "B": 16.67, "C": 66.67, "D": 100.0}
    place = {r.k: r.percentile for r in numbering.percentiles_by_place(df, "v", "k").collect()}
    assert place == {"A": 0.0, "B": 33.33, "C": 66.67, "D": 100.0}
    one = df.limit(1)
    assert numbering.percentiles_by_place(one, "v", "k").first().percentile == 100.0
    assert numbering.percentiles_by_mean_rank(df.where("false"), "v").collect() == []


def test_numbered_is_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    rows = numbering.numbered(df, [F.col("v").asc()]).collect()
    assert sorted((r.v, r.row) for r in rows) == [(i, i + 1) for i in range(5000)]


def test_agreement(spark):
    rows = spark.createDataFrame([("g", "1", x) for x in "abc"] + [("g", "2", x) for x in "abd"] + [("h", "1", None), ("h", "2", None), ("k", "1", "a"), ("m", "1", "a"), ("m", "2", None)], "g string, run string, object string")
    got = {r.g: r.score for r in consistency.scores(rows, ["g"]).collect()}
    assert got == {"g": 0.5, "h": 1.0, "k": 1.0, "m": 0.0}
    bad = {(r.object, tuple(r.missing)) for r in consistency.inconsistencies(rows.where("g = 'g'"), ["g"]).collect()}
    assert bad == {("c", ("2",)), ("d", ("1",))}
    empty = rows.where("false").select("object")
    assert consistency.compared(empty, empty).first().jaccard == 1.0


def test_names(spark):
    assert column(spark, ["Data Access-Layer!", None], lambda c: text.node_id("concept", F.lit("r"), c))[0] == "concept_r_data_access_layer"
    assert column(spark, ["policies", "boxes", "people", "data", "class", "s", "orders"], text.singular) == ["policy", "box", "person", "data", "class", "s", "order"]
    assert column(spark, ["Cities", "CITIES", "Indices", "Analytics", "bases", "days", "media", "series", "buses"], text.singular) == ["City", "CITY", "Index", "Analytics", "base", "day", "medium", "sery", "bus"]
    assert column(spark, ["flask_sqlalchemy", "Flask", "orders_db", "redis_service", "Left Pad", "my_orm", "K8S", "react_lib", ""], text.package_name) == ["Flask-SQLAlchemy", "Flask", "orders", "Redis", "Left Pad", "my", "Kubernetes", "React", ""]
    assert column(spark, ["parsing", "technical", "quickly", "generating", "editing", "entries", "leaves", "items", "add", "handler", "processes", "ally"], text.lemma) == ["parse", "techn", "quick", "generate", "edit", "entry", "leaf", "item", "add", "handl", "process", "ally"]
    assert column(spark, ["user_orders", "fooBar", ""], text.concept_name) == ["UserOrder", "Foobar", ""]
    assert column(spark, ["src\\a.py", "./r/b.py", "r", "."], lambda c: text.normal_path(c, F.lit("r"))) == ["r/src/a.py", "r/b.py", "r", "r"]
    assert column(spark, ["9 lives", "a:b"], text.xml_name) == ["id_9_lives", "a_b"]
    assert column(spark, ["a.py (lines 1-20)"], text.without_chunk_suffix) == ["a.py"]
    assert column(spark, ["the user-db  config"], text.normal_name) == ["user database configuration"]
    assert column(spark, ["The a Customers-Orders", "Generate  Reports", None, "  ", "fetch_user_details"], text.normal_name) == ["customer order", "render report", "", "", "get user detail"]
    assert column(spark, ["Parsing Orders"], lambda c: text.normal_name(c, {"parse": "read"}, True)) == ["read order"]
    assert column(spark, ["```json\n{}\n```", "```{}```", "``` x", "a"], text.without_fence) == ["{}", "{}", "``` x", "a"]
    long = "\n".join(f"line number {i} of a long text" for i in range(100))
    assert column(spark, [long, "short"], lambda c: text.shortened(c, 50)) == ["\n".join(long.split("\n")[:6]) + "\n\n... [90 lines truncated] ...\n\n" + "\n".join(long.split("\n")[-4:]), "short"]
    assert column(spark, ["x ```json\n{\"a\": 1}\n``` y", "[1]", "so {\"b\": {}} it", "no"], text.json_of) == ['{"a": 1}', "[1]", '{"b": {}}', "no"]
    assert column(spark, ["s:m:r:3", "s:m:r:x", "a:1"], text.run_parts)[1:] == [None, None]
    assert column(spark, [None, "", "abcd", "abcdefg"], text.token_estimate) == [0, 0, 1, 1]


def test_manifests(spark):
    df = spark.createDataFrame([("a", "flask>=2.0\nFlask==1\n# no\n-e .\nx @ http://h/x\nnumpy[all] ~=1.2; python_version>'3'\n\n")], "node_id string, content string")
    assert {(r.name, r.version) for r in extract.requirements(df).collect()} == {("flask", "2.0"), ("x", None), ("numpy", "1.2")}
    toml = spark.createDataFrame([("a", '[project]\ndependencies = [\n "rich>=13",\n \'click\'\n]\n')], "node_id string, content string")
    assert {(r.name, r.version) for r in extract.pyproject(toml).collect()} == {("rich", "13"), ("click", None)}
    pack = spark.createDataFrame([("a", '{"dependencies": {"x": "1", "y": {"v": 1}}, "devDependencies": {"x": "2", "z": "3"}}'), ("b", "{no")], "node_id string, content string")
    assert {(r.name, r.version) for r in extract.package_json(pack).collect()} == {("x", "1"), ("y", None), ("z", "3")}


def test_syntax_tree_records(spark):
    code = "import os, numpy.linalg\nfrom . import x\nfrom pandas import y\nclass A:\n    @staticmethod\n    def f(a: int, *b, **c) -> str: pass\n    async def __g(self): pass\ndef h(): import re\n"
    df = spark.createDataFrame([("n", code), ("bad", "def ("), ("none", None)], "node_id string, content string")
    rec = extract.python_records(df)
    assert {r.name for r in extract.imported_packages(rec).collect()} == {"numpy", "pandas"}
    m = {(r.type_name, r.name, r.parameters, r.result, r.is_static, r.is_async) for r in rec.where("kind = 'method'").collect()}
    assert m == {("A", "f", "a: int, *b, **c", "str", True, False), ("A", "__g", "self", None, False, True), ("", "h", "", None, False, False)}
    assert column(spark, ["__x", "_x", "__x__", "x"], extract.visibility) == ["protected", "private", "private", "public"]


def test_chunks():
    t = "".join(f"line {i:03d}\n" for i in range(100))
    got = chunks.by_lines(t, 50, 2)
    assert all(len(c) // 4 <= 50 for _, _, c in got)
    assert got[0][0] == 1 and got[-1][1] == 100 and all(b[0] == a[1] - 1 for a, b in zip(got, got[1:]))
    assert chunks.by_lines("x" * 999, 10) == [(1, 1, "x" * 999)]
    parts = chunks.by_delimiter(t, 60, "line 02")
    assert "".join(c for _, _, c in parts) == t
    assert chunks.model_limit("gpt-4") == 6553 and chunks.model_limit("none") == 3200 and chunks.model_limit(None) == 3200
    assert chunks.model_limit("GPT-4o-Mini") == 102400 and chunks.model_limit("claude-3-opus-2024") == 160000 and chunks.model_limit("gpt-4.1-mini") == 800000 and chunks.model_limit("mist") == 25600
    # sections are counted one by one, and the last of one chunk begin the next
    got = chunks.by_delimiter("a" * 40 + "#" + "b" * 39 + "#" + "c" * 39 + "#", 20, "#", 1)
    assert got == [(1, 1, "a" * 40 + "#" + "b" * 39), (2, 2, "#" + "b" * 39 + "#" + "c" * 39)]
    assert [x[:2] for x in chunks.by_delimiter("#one\n" * 3 + "#" + "long line of it\n" * 9, 8, "#")] == [(1, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 13)]


def test_classes_and_test_targets(spark):
    reg = spark.createDataFrame([(".py", "source", "python"), ("makefile", "build", "make"), ("path:**/tests/**", "test", "suite"), ("*.lock", "dependency", None), (None, "x", None), (".zz", None, None)], "extension string, file_type string, subtype string")
    f = spark.createDataFrame([(p, p, "r") for p in ("a.py", "tests/a.py", "Makefile", "x.lock", "noext", "b.zz", "src/tests/test_a.py", "src/a.py")], "node_id string, file_path string, repository_name string")
    got = {r.file_path: (r.found_type, r.reason) for r in classify.classified(f, reg).collect()}
    assert got["tests/a.py"][0] == "test" and got["Makefile"][0] == "build" and got["x.lock"][0] == "dependency" and got["a.py"][0] == "source"
    assert got["noext"] == (None, "no_extension") and got["b.zz"] == (None, "unknown_extension")
    paths = ["test_a.py", "a.py", "lib/b_test.py", "lib/b.py", "web/c.spec.ts", "web/c.ts", "tests/unit/test_d.py", "src/unit/d.py", "x/tests/y/test_e.py", "x/tests/e.py", "tests/f.py", "f.py", "deep/tests/z/test_f.py"]
    f = spark.createDataFrame([(p, p, "r") for p in paths], "node_id string, file_path string, repository_name string")
    got = {r.test_id: (r.source_id, r.candidate_no) for r in classify.test_targets(f).collect()}
    assert got == {"test_a.py": ("a.py", 0), "lib/b_test.py": ("lib/b.py", 1), "web/c.spec.ts": ("web/c.ts", 2), "tests/unit/test_d.py": ("src/unit/d.py", 3), "x/tests/y/test_e.py": ("x/tests/e.py", 5), "tests/f.py": ("f.py", 4), "deep/tests/z/test_f.py": ("f.py", 4)}


def test_similar_names_lose_no_pair(spark):
    import itertools
    import random

    r = random.Random(2)
    base = ["customer order service", "billing adapter", "ledger exporter unit"]
    names = {"".join(c for c in b if r.random() > 0.06) + r.choice(["", "s", "x"]) for b in base for _ in range(25)}
    df = spark.createDataFrame([(str(i), n, "T", "r", True) for i, n in enumerate(sorted(names))], "identifier string, name string, element_type string, repository_name string, enabled boolean")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    # words that mean the same count as equal
    plain = {n: column(spark, [n], text.normal_name)[0] for n in names}
    names = set(plain.values())
    want = {frozenset((a, b)) for a, b in itertools.combinations(names, 2) if 1 - edits(a, b) / max(len(a), len(b)) >= 0.85}
    want |= {frozenset((a,)) for a in names if list(plain.values()).count(a) > 1}
    assert {frozenset((x.name, x.other)) for x in model.similar_elements(df).collect()} == want


def test_model_document_and_versions(spark):
    e = spark.createDataFrame([("a", "A & <b>", "Node", None), ("b", "B", "Device", "d")], "identifier string, name string, element_type string, documentation string")
    r = spark.createDataFrame([("r", "a", "b", "Composition")], "identifier string, source_id string, target_id string, relationship_type string")
    import xml.etree.ElementTree as ET

    lines = [x.line for x in files.model_lines(files.model_parts(e, r), 'm & "n"').orderBy("place", "identifier").collect()]
    root = ET.fromstring("\n".join(lines).encode())
    assert [len(x) for x in root] == [0, 2, 1] and root[0].text == 'm & "n"'
    assert len(files.model_lines(files.model_parts(e, r.where("false")), "m").collect()) == 6
    base = spark.createDataFrame([("k", 1, "x")], "id string, n int, s string")
    new = spark.createDataFrame([("k", None, "y"), ("l", 2, None)], "id string, n int, s string")
    assert {tuple(x) for x in versioning.upserted(base, new, ["id"]).collect()} == {("k", 1, "y"), ("l", 2, None)}


def test_responses(spark):
    df = spark.createDataFrame([("1", '{"dependencies": [{"dependencyName": "a"}]}'), ("2", '[{"dependencyName": "b"}]'), ("6", '{"dependencies": 1, "items": [{"dependencyName": "d"}]}'), ("7", '{"result": {}, "results": [{"dependencyName": "e", "dependencyCategory": "External_API"}]}'), ("3", '{"externalDependencies": [{"dependencyName": "c", "dependencyCategory": "odd"}]}'), ("4", "no"), ("5", None)], "k string, content string")
    got = responses.coerced_fields(responses.parsed(df, "dependencies")).collect()
    assert {(r.k, r.dependencyName) for r in got} == {("1", "a"), ("2", "b"), ("3", "c"), ("7", "e")} and {r.dependencyCategory for r in got} == {"library", "external_api"}
    types = spark.createDataFrame([("REST API", "Class"), ("none", "odd"), (None, None)], "interfaceType string, category string")
    assert [tuple(r) for r in responses.coerced_fields(types).collect()] == [("REST API", "class"), (None, "other"), (None, "other")]
    why = {r.k: r.w for r in df.select("k", responses.parse_error("elements", F.col("content")).alias("w")).collect()}
    assert why["4"] == "not json" and why["5"] == "empty" and why["1"] == "no list"


def test_event_document_and_run_log(spark, tmp_path):
    doc = {"ocel:events": [{"ocel:eid": "e1", "ocel:activity": "Extract", "ocel:timestamp": "2025-01-01T00:00:00Z", "ocel:typedOmap": {"File": ["f"], "Run": ["r"]}, "ocel:vmap": {"n": "1"}}, {"ocel:activity": "Load", "ocel:timestamp": "2025-01-02T00:00:00Z"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    log = eventlog.read_document(spark, str(tmp_path / "d.json"))
    e = log.orderBy("timestamp").first()
    assert e.activity == "Extract" and e.objects == {"File": ["f"], "Run": ["r"]} and log.count() == 2
    text_ = "\n".join(r.line for r in eventlog.document_lines(log).orderBy("part", "place").collect())
    back = json.loads(text_)
    assert back["ocel:global-log"] == {"ocel:version": "2.0", "ocel:ordering": "timestamp", "ocel:object-types": ["File", "Run"], "ocel:attribute-names": ["n"], "ocel:events": 2}
    assert back["ocel:objects"] == {"f": {"ocel:type": "File"}, "r": {"ocel:type": "Run"}} and back["ocel:events"][0]["ocel:omap"] == ["f", "r"] and back["ocel:events"][0]["ocel:timestamp"] == "2025-01-01T00:00:00Z"
    eventlog.write_lines(log, str(tmp_path / "lines"))
    assert eventlog.read_lines(spark, str(tmp_path / "lines")).count() == 2
    (tmp_path / "log_1.jsonl").write_text('{"level": 2, "message": "old"}\n')
    (tmp_path / "log_2.jsonl").write_text('{"level": 1, "message": "a"}\nbroken\n{"level": 2, "message": "b"}\n')
    assert [r.message for r in eventlog.read_run_logs(spark, str(tmp_path / "log_*.jsonl"), 2, latest=True).collect()] == ["b"]
    assert eventlog.read_run_logs(spark, str(tmp_path / "log_*.jsonl"), 2).count() == 2


def test_events_as_they_arise(spark):
    rows = spark.createDataFrame([("s", "r1", "repo", "m", "File", dt.datetime(2025, 1, 1), ["a", "b"], None, None)], "session string, run string, repository string, model string, config string, at timestamp, objects array<string>, edges array<string>, relationships array<string>")
    made = eventlog.config_events(rows, True)
    e = made.first()
    assert e.activity == "ExtractConfig" and e.objects["GraphNode"] == ["a", "b"] and "Edge" not in e.objects and e.attributes["objects_created"] == "2" and len(e.event_id) == 12
    assert eventlog.appended(made, made).count() == 1 and eventlog.appended(made.where("false"), made.unionAll(made)).count() == 1
    calls = spark.createDataFrame([("r1", "m", None, dt.datetime(2025, 1, 1), None, 3, True, "x")], "run string, model string, config string, at timestamp, tokens_in int, tokens_out int, cache_hit boolean, content string")
    q = eventlog.query_events(calls).first()
    assert q.objects["Config"] == [] and q.attributes["tokens_in"] == "0" and len(q.attributes["response_hash"]) == 16
    done = spark.createDataFrame([("1", "CompleteRun", {"Model": ["m"]}, {"stats": '{"extraction": {"nodes_created": 4}}'}), ("2", "CompleteRun", {}, {}), ("3", "Other", {"Model": ["m"]}, {})], "event_id string, activity string, objects map<string,array<string>>, attributes map<string,string>")
    assert [tuple(r) for r in eventlog.run_totals(done).collect()] == [("m", "1", 4, 0)]


def test_consistency_of_models_and_where_it_is_weak(spark):
    runs = spark.createDataFrame([("m", "r", str(i), i) for i in range(3)] + [("n", "r", "0", 1)], "model string, repository string, run string, made int")
    rows = spark.createDataFrame([("m", "r", str(i), o) for i, o in ((0, "a"), (1, "a"), (2, "a"), (0, "b"), (2, "b"), (2, "b"))], "model string, repository string, run string, object string")
    within = consistency.within_models(rows, runs)
    assert [tuple(r) for r in within.collect()] == [("m", "r", 3, 2, 1, pytest.approx(2 / 3), 50.0)]
    assert consistency.within_models(rows.where("false"), runs).first().consistency == 100.0
    stages = spark.createDataFrame([("extraction", 100.0), ("derivation", 60.0)], "name string, consistency double")
    kinds = spark.createDataFrame([("Edge", 0.4), ("Element", 0.1)], "name string, score double")
    located = consistency.localised(within, stages, kinds)
    assert {(r.dimension, r.name, r.score) for r in located.collect()} == {("model", "m", 50.0), ("repository", "r", 50.0), ("stage", "extraction", 100.0), ("stage", "derivation", 60.0), ("object_type", "Edge", 40.0), ("object_type", "Element", 10.0)}
    assert [(r.name, r.severity) for r in consistency.weak_spots(located).collect()] == [("m", "medium"), ("derivation", "medium"), ("Edge", "high")]
    across = consistency.across_models(rows.select("repository", F.col("run").alias("model"), "object"), ["repository"])
    assert consistency.overall_of(within, across).first().overall == 50.0 and consistency.overall_of(within.where("false"), across.where("false")).first().overall == 100.0
    lists = {(r.side, r.place, r.object) for r in consistency.stability_lists(rows, ["model"], 1).collect()}
    assert lists == {("stable", 1, "a"), ("deviating", 1, "b")}
    good = spark.createDataFrame([("x", 0.9)], "name string, score double")
    assert [tuple(r)[:2] for r in consistency.recommendations(good, "name").collect()] == [(None, "GOOD")]
    assert column(spark, ["AC_1", "my-Service", "do_x", "art_1", "Other_x"], consistency.element_type_of) == ["ApplicationComponent", "ApplicationService", "DataObject", "Artifact", "Other"]
    d = consistency.details(rows.select(F.concat(F.lit("s:m:r:"), "run").alias("run"), "object"), F.lit("t"), "t").orderBy("consistency").collect()
    assert [(r.object, r.present, r.missing) for r in d] == [("b", 2, 1), ("a", 3, 0)] and d[0].missing_runs[0].iteration == 1
    assert consistency.stability_verdict(rows, rows).first().verdict == "not better"


def test_nodes_of_responses(spark):
    df = spark.createDataFrame([("r", "a.py", '{"concepts": [{"conceptName": "Big Order", "conceptType": "odd"}, {"conceptName": "", "conceptType": "rule"}]}'), ("r", "b.py", '{"concepts": [{"conceptName": "big-order", "conceptType": "Rule"}]}')], "repository_name string, file_path string, content string")
    nodes, edges, bad = responses.extracted_nodes(df, "concepts")
    assert [(n.node_id, n.file_path, n.conceptType) for n in nodes.collect()] == [("concept_r_big_order", "a.py", "other")]
    assert {(e.source, e.relationship_type) for e in edges.collect()} == {("file_r_a.py", "REFERENCES"), ("file_r_b.py", "REFERENCES")} and [b.missing for b in bad.collect()] == [["conceptName"]]
    dep = spark.createDataFrame([("r", "a.py", '{"items": [{"dependencyName": "Left/Pad x", "dependencyCategory": "library"}]}')], df.schema)
    nodes = responses.extracted_nodes(dep, "dependencies")[0]
    assert nodes.first().node_id == "extdep_r_left_pad_x"
    flask = nodes.withColumn("dependencyName", F.lit("flask_orm"))
    assert tuple(responses.normalised_nodes(flask, "ExternalDependency", "dependencyName").select("node_id", "dependencyName").first()) == ("extdep_r_flask", "Flask")
    props = spark.createDataFrame([('{"name": "A", "tech_category": "x"}',), ('{"techName": "B", "confidence": 0.5}',)], "p string")
    assert [tuple(r.n) for r in props.select(responses.node_of("Technology", F.col("p")).alias("n")).collect()] == [("A", "x", None, None, 0.8), ("B", "service", None, None, 0.5)]


def test_prompts_and_rules(spark):
    e = spark.createDataFrame([(1, "a", "A", "DataObject"), (1, "b", "B", "TechnologyService"), (1, "c", "C", "Node")], "batch int, identifier string, name string, element_type string")
    rules = responses.relationship_rules(spark)
    p = responses.relationship_prompts(e, "Relate.").first().prompt
    assert p.startswith("Relate.") and '["a","b","c"]' in p
    got = {r.element_type: r.prompt for r in responses.element_type_prompts(e, e, rules, "Go.").collect()}
    assert set(got) == {"DataObject", "TechnologyService"} and "Realization TechnologyService" in got["DataObject"]
    both = {r.element_type: r.prompt for r in responses.unified_prompts(e, e.where("identifier = 'b'"), rules, "Go.").collect()}
    assert set(both) == {"DataObject"} and "inbound Access TechnologyService" in both["DataObject"]
    assert {r.identifier for r in responses.relevant_elements(rules, e, "DataObject").collect()} == {"b"}
    assert responses.applicable_rules(rules, e.where("false")).count() == 0


def test_survivors_reasons_and_ends(spark):
    e = spark.createDataFrame([("a", "N", "Node", "r", True, None, {"source_pagerank": "0.2"}), ("b", "N", "Node", "r", True, "long text", {}), ("c", "N", "Node", "r", True, "x", {"source_pagerank": "0.2"}), ("d", "D", "Odd", "r", False, None, None)], "identifier string, name string, element_type string, repository_name string, enabled boolean, documentation string, properties map<string,string>")
    assert {(r.identifier, r.kept_id) for r in model.equal_elements(e).collect()} == {("a", "c"), ("b", "c")}
    r = spark.createDataFrame([("1", "a", "b", "Composition"), ("2", "a", "b", "Access"), ("3", "a", "b", "Flow"), ("4", "d", "a", "Flow"), ("5", "a", "d", "Flow"), ("6", "a", "b", "Uses"), ("7", "a", None, "Flow")], "identifier string, source_id string, target_id string, relationship_type string")
    assert {x.identifier: x.reason for x in model.relationship_validity(r, e).collect()} == {"1": None, "2": "target not allowed", "3": "source not allowed", "4": "unknown source type", "5": "unknown target type", "6": "unknown relationship type"}
    ids = lambda df: {x.identifier for x in df.collect()}
    assert ids(model.relationships_between(r, e)) == set("123456") and ids(model.relationships_between(r, e, target="b")) == set("1236") and ids(model.relationships_between(r, e, "d", "a")) == {"4"}
    assert model.flow_serving(e, r).first().relationships == 1 and {x.relationship_type for x in model.relationships_from(spark, "DataObject").collect()} == set()


def test_configuration_tables(spark):
    c = spark.createDataFrame([(1, "File", 1, 2, True, True, "x"), (2, "Test", 1, 1, False, True, None), (3, "Old", 1, 0, True, False, "y")], "id int, node_type string, version int, sequence int, enabled boolean, is_active boolean, instruction string")
    assert [(r.name, r.has_instruction) for r in versioning.steps(c, "node_type").collect()] == [("Test", False), ("File", True)]
    assert versioning.steps(versioning.with_step(c, "node_type", "Test", True), "node_type", True).count() == 2
    reg = spark.createDataFrame([(".py", "source", "python", 5)], "extension string, file_type string, subtype string, chunk_max_tokens int")
    more = versioning.type_added(versioning.type_added(reg, ".py", "x", "y"), ".rb", "source", "ruby")
    assert {(r.extension, r.file_type, r.chunk_max_tokens) for r in more.collect()} == {(".py", "source", 5), (".rb", "source", None)}
    assert tuple(versioning.registry_facts(versioning.type_changed(more, ".rb", "docs", None)).first()) == (2, 1, 2) and versioning.type_deleted(more, ".py").count() == 1
    s = spark.createDataFrame([("a", "1")], "key string, value string")
    assert {tuple(r) for r in versioning.setting(versioning.setting(s, "a", "2"), "b", "3").collect()} == {("a", "2"), ("b", "3")}
    h = spark.createDataFrame([(4, "r")], "id int, repo string")
    assert versioning.logged(h, {"repo": "s"}).orderBy("id").collect()[1].id == 5
    assert versioning.migrated(s, "key string, note string, n int").columns == ["key", "value", "note", "n"]
    runs = spark.createDataFrame([("s", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2), "completed"), ("s", dt.datetime(2025, 1, 2), None, "running"), ("t", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 3), "failed")], "session_id string, started_at timestamp, completed_at timestamp, status string")
    assert {r.session_id: (r.status, r.finished is None) for r in versioning.session_rows(runs).collect()} == {"s": ("running", True), "t": ("failed", False)}
    empty = s.where("false")
    assert files.seeded(empty, s).count() == 1 and files.seeded(s, empty).count() == 1 and files.seeded(s, empty, True).count() == 0
    assert files.read_rows(spark, "/nowhere/at/all.json", "a int").count() == 0
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), "t", 4)
    pat = spark.createDataFrame([("st", "include", "c", '["a"]', True)], "step_name string, pattern_type string, pattern_category string, patterns string, is_active boolean")
    assert {(r.pattern_type, r.patterns) for r in versioning.patterns_set(versioning.patterns_set(pat, "st", "include", "c", ["b"]), "st", "exclude", "c", []).collect()} == {("include", '["b"]'), ("exclude", "[]")}


def test_catalogue_and_pace(spark):
    types = catalogue.node_types(spark)
    assert types.select("node_type").distinct().count() == 11 and types.where("node_type = 'Repository'").first().place == 1 and catalogue.edge_types(spark).count() == 9
    shape = catalogue.array_shape("n", "items", {"a": {"type": "string"}}, ["a"])
    assert shape["schema"]["properties"]["items"]["items"] == {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": True} and shape["schema"]["additionalProperties"] is False
    assert tuple(catalogue.stored_facts(spark.createDataFrame([("aé",), (None,)], "content string")).first()) == (2, 3, 0.0)
    now, slept = [0.0], []
    pace = catalogue.Pace(2, 1.0, jitter=0, clock=lambda: now[0], sleep=slept.append)
    assert [pace.wait(), pace.wait(), pace.wait()] == [0.0, 1.0, 60.0] and slept == [1.0, 60.0]
    assert [pace.rejected(), pace.rejected()] == [2.0, 4.0]
    pace.accepted()
    assert pace.rejected() == 2.0


def test_chunk_labels_and_descriptions(spark):
    c = spark.createDataFrame([("a", "x.py", 0, 2, 1, 4), ("b", "y.py", 0, 1, 1, 9)], "node_id string, file_path string, chunk_no int, chunks int, start_line int, end_line int")
    assert {r.label for r in chunks.labelled(c).collect()} == {"x.py (lines 1-4)", "y.py"}
    n = spark.createDataFrame([("f", "n", 1, "late"), ("f", "n", 0, "first"), ("g", "n", 5, "other"), ("f", None, 0, "no")], "file string, node_id string, chunk_no int, v string")
    assert {r.v for r in chunks.once_per_file(n).collect()} == {"first", "other"}
    d = spark.createDataFrame([("r", "README.md", "# Title\n\nFirst.\nSecond.\nThird.\nFourth."), ("r", "README", "No"), ("s", "README.md", "# only"), ("s", "README.txt", "Text"), ("t", "sub/README.md", "x")], "repository_name string, path string, content string")
    assert {(r.repository_name, r.description) for r in files.repository_descriptions(d).collect()} == {("r", "First. Second. Third."), ("s", "Text")}
    assert column(spark, ["a/requirements.txt", "dev-Requirements.TXT", "requirements-dev.txt", "x/pyproject.toml", "package.json", "a.py"], lambda p: extract.method_of(p, F.when(p == "a.py", "Python"))) == ["requirements_txt", "requirements_txt", "llm", "pyproject_toml", "package_json", "python_ast"]


def test_scan_decodes(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("no")
    (tmp_path / "a.txt").write_bytes("ä".encode("utf-16"))
    (tmp_path / "b.txt").write_bytes("ä".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbf" + "ä".encode())
    got = {r.path: r.t for r in files.scanned(spark, str(tmp_path)).select("path", files.decoded(F.col("content")).alias("t")).collect()}
    assert got == {"a.txt": "ä", "b.txt": "ä", "c.txt": "ä"}


def test_two_buckets_do_not_share_slots(spark):
    df = spark.createDataFrame([(f"n{i}", i < 6, float(i)) for i in range(8)], "node_id string, l boolean, pagerank double")
    assert len(ranking.two_buckets(df, "l", 6).collect()) == 5
    with pytest.raises(KeyError):
        from lodestone.operators.graph import enriched

        enriched(spark.createDataFrame([("a", "b")], "source string, target string"), ["nothing"])


def test_python_records_behind_a_byte_order_mark(spark):
    text = "import numpy\n\nclass A:\n    def f(self): pass\n"
    df = spark.createDataFrame([("plain", text), ("mark", "\ufeff" + text), ("two", "\ufeff\ufeff" + text)], "node_id string, content string")
    rows = {n: sorted(tuple(r)[1:] for r in extract.python_records(df).where(f"node_id = '{n}'").collect()) for n in ("plain", "mark", "two")}
    assert rows["mark"] == rows["plain"] and len(rows["plain"]) == 3 and rows["two"] == []
