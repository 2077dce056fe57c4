import datetime as dt

from lodestone.llm import source_files as sf
from lodestone.llm.languages import LEXERS
from lodestone.llm.symbols import SYMBOLS, useful_words

FILE = "node_id string, file_path string, repository_name string, file_type string, subtype string, created_at timestamp, language string, content string, parses boolean"
TEXT = "node_id string, content string, read_at timestamp, file_path string"


def tables(spark, rows):
    """rows: node, path, text"""
    files = spark.createDataFrame([(n, p, "r_x", "source", "python", dt.datetime(2025, 1, 1), "odd", "odd", True) for n, p, _ in rows], FILE)
    texts = spark.createDataFrame([(n, t, None, "odd") for n, t in dict((n, t) for n, _, t in rows).items()], TEXT)
    return files, texts


ROWS = [("a", "x/a.PY", "def f(:"), ("a", "x/a.PY", "def f(:"), ("b", "b.js", None), ("c", "c.go", ""), ("d", "d.txt", "def f(:"), (None, "e.py", "x"), ("g", None, "x"), ("h", "h.py", "x = 1\n" * 5000)]


def test_flags_with_nulls_repeats_and_long_texts(spark):
    assert [r.node_id for r in sf.unparsable(*tables(spark, ROWS)).collect()] == ["a"]


def test_empty_tables(spark):
    files, texts = (t.where("false") for t in tables(spark, ROWS))
    cfg = spark.createDataFrame([], "node_type string, is_active boolean, input_sources string, extraction_method string, file_type string")
    assert sf.unparsable(files, texts).collect() == [] and sf.documented_functions(files, texts).collect() == []
    assert sf.unparsable_rates(files, texts, cfg).collect() == []
    cand = spark.createDataFrame([("x", {"methodName": "m"})], "node_id string, properties map<string,string>")
    assert sf.completed_candidates(cand, files, texts).first().status == "unknown"


def test_rates(spark):
    cfg = spark.createDataFrame([("M", True, '{"files": [{"type": "source", "subtype": "*"}]}', "ast", "y"), ("M", True, None, "llm", "y"), ("N", True, "{no", "llm", "y")], "node_type string, is_active boolean, input_sources string, extraction_method string, file_type string")
    got = {(r.dimension, r.key): (r.files, r.broken) for r in sf.unparsable_rates(*tables(spark, ROWS), cfg).collect()}
    assert got == {("repository", "r_x"): (3, 1), ("language", "python"): (2, 1), ("language", "go"): (1, 0), ("extraction_method", "ast"): (3, 1)}


def found(language, text):
    return [(s.type_name, s.method_name, s.doc and s.doc.strip()) for s in SYMBOLS[language](LEXERS[language](text))]


def test_symbols_by_language():
    js = "/** one two three */\n@dec\nexport async function f(a: string): void {\n  /** x */\n  function inner() {}\n}\n/** k */\nexport const g = async (x) => { };\nclass A {\n  constructor() {}\n  /** m doc */\n  @d(1) static async m<T>(a): Promise<T> { }\n  // no\n  n() {}\n  p = 1\n  get q() { return 1 }\n}\nlet z = () => 1;\n"
    assert found("typescript", js) == [("", "f", "one two three"), ("", "g", "k"), ("A", "m", "m doc"), ("A", "n", None), ("A", "q", None)]
    java = "package p;\n/** type */\npublic class A {\n  int x = 1;\n  A() {}\n  /** doc\n   * @param a b\n   */\n  @Override public <T> List<T> m(Map<K, V> a, int[] b) { new Object() { void no() {} }; }\n  @Deprecated\n  /** after */\n  void n() {}\n  static class B { /** b */ void o() {} }\n}\n"
    assert found("java", java) == [("A", "m", "doc\n@param a b"), ("A", "n", "after"), ("B", "o", "b")]
    go = "package p\n\n// far\n\nfunc a() {}\n\n// one\n// two\nfunc (t *T) b(x int) {}\n\n/* c */\nfunc (T[K]) c() {}\nvar s = \"// d\"\nfunc d() {}\n"
    assert found("go", go) == [("", "a", None), ("T", "b", "one\ntwo"), ("T", "c", "c"), ("", "d", None)]
    py = "class A:\n    'no'\n    def __init__(self): 'x'\n    async def m(self):\n        r'''doc'''\n        def inner():\n            'y'\ndef f(): return 'z'\nif x:\n    def g():\n        f'no'\n"
    assert found("python", py) == [("A", "m", "doc"), ("", "f", None), ("", "g", None)]


def test_useful_words():
    assert useful_words("Loads the user order.", "", "load_user_order") == 2
    assert useful_words("@param a b c d\n:returns: x y z w\nreally kept here", "T", "f") == 3
    assert useful_words("HTTP server parse now", "HTTPServer", "parseNow") == 0


def test_declarations_join_definitions_by_signature(spark):
    ts = "export abstract class A {\n  /** says what it does well */\n  abstract m(a: string): void;\n  /** other text for numbers only */\n  abstract m(a: number): void;\n}\n"
    impl = "export class A {\n  m(a: number) { }\n}\n"
    files, texts = tables(spark, [("1", "a.ts", ts), ("2", "b.ts", impl)])
    got = {(r.node_id, r.doc_source, r.description.strip()) for r in sf.documented_functions(files, texts).collect()}
    assert ("2", "declaration", "other text for numbers only") in got and len(got) == 3
    assert {r.node_id for r in sf.found_functions(files, texts).collect()} == {"1"}


def described(spark, *texts):
    files, table = tables(spark, [(str(i), p, t) for i, (p, t) in enumerate(texts)])
    return {(r.node_id, r.type_name, r.method_name, r.doc_source, r.description.strip()) for r in sf.documented_functions(files, table).collect()}, sf.found_functions(files, table).collect()


def test_interfaces_and_base_types_document_what_implements_them(spark):
    ts = "export interface Store<T> {\n  /** keeps one value under its key */\n  put(key: string, v: T): void;\n  size: number\n}\n"
    base = "export class Base implements Store<number> {\n  // later\n  put(key: string, v: number): void { }\n}\n"
    far = "export class Far extends Base {\n  /** TODO */\n  put(k, x) { }\n  /** its own words stay here */\n  get(k) { }\n}\n"
    got, found = described(spark, ("a.ts", ts), ("b.ts", base), ("c.js", far))
    assert got == {("1", "Base", "put", "declaration", "keeps one value under its key"), ("2", "Far", "put", "declaration", "keeps one value under its key"), ("2", "Far", "get", "own", "its own words stay here")}
    assert [(r.node_id, r.method_name) for r in found] == [("2", "get")]


def test_overloads_abstract_methods_and_stubs(spark):
    java = "package p;\ninterface Rule { /** tells whether the order passes now */ boolean check(Order o, int[] n);\n /** any other kind of thing */ boolean check(Thing t); }\n"
    impl = "package p;\nclass Strict extends Other<Rule> implements Rule { public boolean check(Order order, int[] m) { return true; } public boolean check(String s) { return false; } }\n"
    py = "class Abstract:\n    def run(self):\n        '''starts all waiting jobs again'''\n        raise NotImplementedError\n    def stop(self):\n        'halts every other job too'\n        return 1\n"
    sub = "class Sub(pkg.Abstract, metaclass=M):\n    def run(self):\n        return 2\n    def stop(self):\n        return 3\n"
    got, _ = described(spark, ("a.java", java), ("b.java", impl), ("c.py", py), ("d.py", sub))
    assert {g for g in got if g[0] in "13"} == {
        ("1", "Strict", "check", "declaration", "tells whether the order passes now"), ("1", "Strict", "check", "declaration", "any other kind of thing"), ("3", "Sub", "run", "declaration", "starts all waiting jobs again"),
    }
    assert {g[2] for g in got if g[0] in "02"} == {"check", "run", "stop"}


def test_words_are_counted_against_the_names_of_the_definition(spark):
    got, _ = described(spark, ("a.ts", "abstract class Loader { /** load the big file */ abstract go(a): void }\n"), ("b.ts", "class BigFile extends Loader { go(b) { } }\nclass Near extends Loader { go(b) { } }\n"))
    assert ("1", "Near", "go", "declaration", "load the big file") in got and not any(g[1] == "BigFile" for g in got)


def test_code_is_cut_by_offset_after_marks_and_line_ends_are_normal(spark):
    files, texts = tables(spark, [("1", "a.py", "﻿x = 1\r\ndef f():\r\n    'gives back only ones'\r\n    return 1\r\n\r\ny = 2\r\n")])
    (row,) = sf.documented_functions(files, texts).collect()
    assert row.code == "def f():\n    'gives back only ones'\n    return 1\n"


def test_types_that_extend_each_other_end(spark):
    got, _ = described(spark, ("a.py", "class A(B):\n    def f(self):\n        pass\nclass B(A):\n    def f(self):\n        return 1\n"))
    assert got == set()
