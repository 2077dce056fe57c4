"""Variants, pieces, packing, mixing, pages and origins against brute force and round trips."""

import collections
import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import handwritten, mixing, packing, pages, pieces, tokens, variants

# ---------------------------------------------------------------- variants
DEP = "record_id bigint, repository_name string, dependency_name string, dependency_category string, ecosystem string, version string, properties_json string, table_name string, copies int"


def dependency_rows(n=300):
    r = random.Random(4)
    out = []
    for i in range(n):
        name = r.choice(["a-b", "A_B", "a b", "ab+", "ab", None, "", "--"])
        props = r.choice(['{"d": "X y", "n": {"l": 1, "p": "a"}}', '{"n":{"p":"A","l":1},"d":"x-Y"}', '{"d": "X y", "n": {"l": 1.0, "p": "a"}}', '{"d": null}', "{}", None, "{bad"])
        out.append((i, r.choice(["r", "R", None]), name, "lib", r.choice(["npm", "NPM", None]), r.choice(["1.0", " 1.0 ", "1.0-A", "1.0-a", None]), props, "t", 1))
    out += [(1000 + i, "hot", "same", "x", None, None, "{}", "t", 1) for i in range(400)]
    return out + [out[0], (None, "r", "a", "b", "c", "d", "{}", "t", 1)]


def brute_groups(rows):
    def plain(v):
        return None if v is None else "".join(c for c in v.lower() if c.isalnum() or c in "+#")

    def value(v):
        if isinstance(v, dict):
            return ("d", tuple(sorted((k, value(x)) for k, x in v.items())))
        return ("s", plain(v)) if isinstance(v, str) else (type(v).__name__, repr(v))

    groups = collections.defaultdict(set)
    for rid, repo, name, cat, eco, ver, props, *_ in rows:
        if rid is None:
            continue
        try:
            p = None if props is None else value(json.loads(props))
        except ValueError:
            p = ("raw", props)
        groups[repo, plain(name), plain(cat), plain(eco), None if ver is None else ver.strip().lower(), p].add(rid)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


@pytest.mark.parametrize("bucket_rows", [50_000, 30])
def test_variants_as_by_brute_force_with_a_hot_group(spark, bucket_rows):
    rows = dependency_rows()
    rec = variants.canonical_records([(spark.createDataFrame(rows, DEP), variants.DEPENDENCIES)])
    got = {(r.kept_id, r.copy_id) for r in variants.variant_copies(rec, bucket_rows).collect()}
    assert got == brute_groups(rows)
    sizes = {r.kept_id: r.copies for r in variants.collapsed(rec, bucket_rows).collect()}
    assert sizes[1000] == 400 and sum(sizes.values()) == len({r[0] for r in rows if r[0] is not None})


def test_variants_of_nothing(spark):
    rec = variants.canonical_records([(spark.createDataFrame([], DEP), variants.DEPENDENCIES)])
    assert variants.variant_copies(rec).collect() == []


# ---------------------------------------------------------------- pieces
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\n\r#é ", max_size=300), st.integers(1, 9), st.integers(0, 3), st.sampled_from([None, "\n#", "\n", "##", "b\n"]), st.integers(3, 40))
def test_pieces_give_back_the_text_and_ranges_see_what_the_whole_shows(text, most, overlap, delimiter, step):
    whole = pieces.boundaries(text, 0, len(text), delimiter)
    halo = pieces.halo_chars(delimiter)
    lines, sections = [], []
    for a in range(0, len(text), step):
        n = min(step, len(text) - a)
        x, y = pieces.boundaries(text[max(0, a - halo) : a + step + halo], a, n, delimiter)
        lines += x
        sections += y
    assert (lines, sections) == whole
    plan = pieces.plan_pieces(len(text), lines, sections, most, overlap)
    parts = [text[a:b] for a, b, _ in plan]
    assert all(len(p) // 4 <= most for p in parts)
    assert "".join(p[s:] for p, (_, _, s) in zip(parts, plan)) == text


def test_pieces_of_tables(spark):
    files = spark.createDataFrame([("a", "x/a.MD", 1), ("a", "x/a.MD", 1), ("b", "b.md", 1), ("c", "c.zip", 1), ("d", None, 1), ("e", "e.md", 1), (None, "f.md", 1)], "node_id string, file_path string, overlap int")
    texts = spark.createDataFrame([("a", "line\n" * 50, 9), ("b", "short", 9), ("c", "x" * 999, 9), ("d", "x" * 999, 9), ("e", None, 9)], "node_id string, content string, max_tokens int")
    reg = spark.createDataFrame([(".md", None, 10, 2), (".zip", None, None, 0), (None, "\n", 5, 1)], "extension string, chunk_delimiter string, chunk_max_tokens int, chunk_overlap int")
    large = pieces.oversized(files, texts, reg)
    assert [r.node_id for r in pieces.cut_files(large).collect()] == ["a"]
    got = sorted(pieces.pieces(files, texts, reg).collect(), key=lambda r: r.piece_no)
    assert "".join(r.text[r.shared_chars :] for r in got) == "line\n" * 50 and {r.shared_chars for r in got} == {0, 10}
    assert pieces.pieces(files.where("false"), texts, reg).collect() == []


def test_a_giant_text_is_many_ranges(spark, monkeypatch):
    r = random.Random(3)
    text = "".join("word é \U0001f600 " * r.randrange(9) + r.choice(["\n", "\r\n", "\n## part ", "\n"]) for _ in range(60_000))
    files = spark.createDataFrame([("a", "a.md"), ("b", "b.md"), ("c", "c.md")], "node_id string, file_path string")
    texts = spark.createDataFrame([("a", text), ("b", "y" * 5000), ("c", "\n## s" * 400)], "node_id string, content string")
    reg = spark.createDataFrame([(".md", "\n##", 90, 1)], "extension string, chunk_delimiter string, chunk_max_tokens int, chunk_overlap int")
    whole = {n: pieces.plan_pieces(len(t), *pieces.boundaries(t, 0, len(t), "\n##"), 90, 1) for n, t in (("a", text), ("b", "y" * 5000), ("c", "\n## s" * 400))}
    for chars in (1 << 20, 3000, 100):
        monkeypatch.setattr(pieces, "RANGE_CHARS", chars)
        got = collections.defaultdict(list)
        for x in pieces.pieces(files, texts, reg).collect():
            got[x.node_id].append((x.piece_no, x.begin_char, x.end_char, x.shared_chars, x.text))
        for n, t in (("a", text), ("b", "y" * 5000), ("c", "\n## s" * 400)):
            assert sorted(got[n]) == [(k, a, b, s, t[a:b]) for k, (a, b, s) in enumerate(whole[n])]
    ranges = pieces.range_table(pieces.oversized(files, texts, reg)).where("node_id = 'a'")
    assert ranges.count() == -(-len(text) // 364) and ranges.agg({"chars": "max"}).first()[0] == 364


# ---------------------------------------------------------------- packing and mixing
def test_packing_keeps_every_token_and_no_container_overflows(spark):
    r = random.Random(6)
    want = {i: r.choice([0, 1, 40, 99, 100, 101, 250, 333]) for i in range(500)}
    sizes = spark.createDataFrame([(i, n, 5, 1) for i, n in want.items()] + [(None, 7, 5, 1), (999, None, 5, 1)], "doc_id bigint, tokens bigint, size bigint, shard int")
    caps = spark.createDataFrame([("k", 100), ("k", 200), ("w", 256), (None, 5), ("z", 0)], "container_kind string, capacity_tokens int")
    old, packing.SHARD_ITEMS = packing.SHARD_ITEMS, 100
    try:
        placed = packing.packed(sizes, caps)
        rows = placed.collect()
    finally:
        packing.SHARD_ITEMS = old
    for kind, cap in (("k", 100), ("w", 256)):
        per_doc, per_box = collections.Counter(), collections.Counter()
        for x in rows:
            if x.container_kind == kind:
                per_doc[x.doc_id] += x.tokens
                per_box[x.container_id] += x.tokens
        assert per_doc == collections.Counter({i: n for i, n in want.items() if n}) and max(per_box.values()) <= cap
    whole = {x.doc_id for x in rows if x.container_kind == "w" and want[x.doc_id] <= 256 and x.piece > 0 and want[x.doc_id] != 256}
    assert whole == set()
    report = {x.container_kind: x for x in packing.packing_report(placed, caps).collect()}
    assert report["k"].fill > 0.9 and report["k"].tokens == sum(want.values())
    assert packing.packed(sizes.where("false"), caps).collect() == [] and packing.packed(sizes, caps.where("false")).collect() == []


def test_sum_of_squares_choice_is_the_least():
    r = random.Random(3)
    ss = packing.SumOfSquares(30)
    for _ in range(400):
        size = r.randint(1, 30)
        before = ss.count.copy()
        cost = lambda c: int((c[1:30] ** 2).sum())
        options = []
        for h in range(0, 30 - size + 1):
            if h == 0 or before[h]:
                c = before.copy()
                if h:
                    c[h] -= 1
                if h + size < 30:
                    c[h + size] += 1
                options.append(cost(c))
        ss.place(size)
        assert cost(ss.count) == min(options)


def test_sainte_lague_as_by_single_seats():
    r = random.Random(8)
    for _ in range(60):
        w = {f"s{i}": r.random() for i in range(r.randint(1, 7))}
        most = {k: r.randint(0, 40) for k in w}
        seats = r.randint(0, 90)
        got = dict.fromkeys(w, 0)
        for _ in range(seats):
            free = [k for k in sorted(w) if got[k] < most[k]]
            if not free:
                break
            got[max(free, key=lambda k: (w[k] / (2 * got[k] + 1), [-ord(c) for c in k]))] += 1
        assert mixing.sainte_lague(w, seats, most) == got


def test_mix_meets_shares_and_limits(spark):
    rows = [(i, "big" if i % 3 else "small", 20 + i % 50, 1) for i in range(6000)] + [(9001, "none", 10, 1), (9002, None, 10, 1), (None, "big", 5, 1)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, order int")
    goal = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(sizes, goal)
    got = {r.source: r for r in report.collect()}
    assert abs(got["small"].reached_share - 0.5 / 0.9) < 0.003 and got["absent"].chosen_tokens == 0
    assert {r.source: r.m for r in mix.groupBy("source").agg({"copies": "max"}).toDF("source", "m").collect()}["small"] <= 3
    none, rep = mixing.mixed(sizes.where("false"), goal)
    assert none.collect() == [] and {r.chosen_tokens for r in rep.collect()} == {0}


def test_token_counts_of_long_texts_are_those_of_the_whole(monkeypatch):
    enc, r = tokens.encoding(tokens.VOCABULARY), random.Random(5)
    texts = ["some words, here\nand there. " * 3000, "\n" * 5000, " \n\t" * 900 + "x", "a1b2" * 700, "don't we'll 12.5 \u00e9t\u00e9 \u3000\u4e2d\u6587 " * 300]
    texts += ["".join(r.choice(["a", "Z", "7", " ", "  ", "\n", "'s", "'", ".", "\u00e9", "\u0301", "\u00bd", "\u4e2d", "_", "\x1c", "\u00a0"]) for _ in range(600)) for _ in range(200)]
    for stretch in (1, 7, 50, 200_000):
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        assert all(tokens.count_tokens(t) == len(enc.encode_ordinary(t)) for t in texts)
    assert tokens.count_tokens("") == 0


def test_best_fit_leaves_the_least_room():
    r = random.Random(4)
    for _ in range(50):
        sizes = [r.randint(1, 20) for _ in range(60)]
        room: list[int] = []
        for s, box in zip(sizes, packing.best_fit(sizes, 20)):
            fits = [x for x in room if x >= s]
            if box == len(room):
                assert not fits
                room.append(20)
            else:
                assert room[box] == min(fits)
            room[box] -= s


def test_seats_go_down_a_tree_of_shards(spark):
    r = random.Random(9)
    held = spark.createDataFrame([("s", i, r.randint(1, 500)) for i in range(100)] + [("t", 0, 10)], "source string, shard bigint, tokens bigint")
    facts = spark.createDataFrame([("s", 100, 2, 700), ("t", 1, 3, 5)], "source string, shards bigint, most bigint, seats bigint")
    total = sum(x.tokens for x in held.where("source = 's'").collect())
    for fan in (1000, 5):
        got = mixing.shard_seats(held, facts, 10, 100, fan).collect()
        assert len(got) == 101 and sum(x.seats for x in got if x.source == "s") == 700 and [x.seats for x in got if x.source == "t"] == [4]
        # shares by tokens, give or take a seat per level of the tree
        assert all(abs(x.seats - 700 * x.tokens / total) <= (1.01 if fan == 1000 else 3) for x in got if x.source == "s")


def test_document_sizes_with_nulls_and_repeats(spark):
    d = spark.createDataFrame([(1, "a b", "s", 5), (1, "a b", "s", 5), (2, None, None, 5), (None, "x", "s", 5)], "doc_id bigint, text string, source string, tokens int")
    assert {(r.doc_id, r.tokens) for r in tokens.document_sizes(d, "source").collect()} == {(1, 2), (2, 0)}


# ---------------------------------------------------------------- pages
PROSE = ["The worker reads each order before the store closes it.", "Nobody has to move them by hand, because the queue keeps its own copy.", "See [the guide](/wiki/guide) for what the parser does with a stale record."]
SPAM = ["\n".join(["cheap tool export", "tool export online", "best tool export"] * 20), ", ".join(["fleet api", "fleet api free"] * 20), "\n".join(f"- [Page {i} name](/wiki/p{i})" for i in range(30)),
        " ".join(f"#tag{i}" for i in range(40)), "\n".join(f"Red chair model - SKU {i}2345 - {i}9.99 EUR - in stock" for i in range(20)), "Our fleet api is fleet api fleet api! Get fleet api, fleet api and fleet api. " * 8]


def test_pages(spark):
    r = random.Random(1)
    docs = [" ".join(r.choice(PROSE) for _ in range(6)) + "\n\n# Title here\n\n" + " ".join(r.choice(PROSE) for _ in range(4)) for _ in range(60)] + SPAM * 5
    docs += [None, "", "   \n\n", "```\n" + "x y z\n" * 50 + "```"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)] + [(0, docs[0], "en"), (None, SPAM[0], "en")], "doc_id bigint, text string, kind string")
    got = {x.doc_id for x in pages.stuffed_pages(df).collect()}
    assert got == set(range(60, 60 + len(SPAM) * 5))
    assert pages.page_kinds(df.where("false")).collect() == []


def test_pairs_among_fresh_words_count():
    listed = " ".join(f"fleet api w{i} v{i}" for i in range(10))
    assert {x[2] for _, x in pages.features(pages.units(listed))} == {4} and pages.seed(pages.features([listed])[0][1]) == 2


def test_expected_counts_as_over_all_paths():
    """One round of the estimation against the sum over all paths of states."""
    import itertools
    import math

    import pandas as pd

    r = random.Random(12)
    model = {"emit": [[[math.log(r.random()) for _ in range(n)] for n in pages.VALUES] for _ in range(4)], "step": [[math.log(x / 10) for x in (1, 2, 3, 4)] for _ in range(4)]}
    free = [x for x in itertools.product(*map(range, pages.VALUES)) if pages.seed(x) is None]
    sure = [x for x in itertools.product(*map(range, pages.VALUES)) if pages.seed(x) is not None]
    code = lambda x: sum(v * math.prod(pages.VALUES[f + 1 :]) for f, v in enumerate(x))
    assert pages._values(code(free[7])) == free[7]
    seen = [r.choice(free), r.choice(free), r.choice(sure), r.choice(free)]
    (got,) = pages._expected(model)(iter([pd.DataFrame({"codes": [[code(x) for x in seen], []]})]))
    want, every = collections.Counter(), 0.0
    for path in itertools.product(range(4), repeat=4):
        if any(pages.seed(x) not in (None, s) for s, x in zip(path, seen)):
            continue
        w = math.exp(sum(model["emit"][s][f][v] for s, x in zip(path, seen) if pages.seed(x) is None for f, v in enumerate(x)) + sum(model["step"][a][b] for a, b in zip(path, path[1:])))
        every += w
        for s, x in zip(path, seen):
            for f, v in enumerate(x):
                want["emit", s, f, v] += w
        for a, b in zip(path, path[1:]):
            want["step", a, b, 0] += w
    found = {(x.kind, x.a, x.b, x.c): x.n for x in got.itertuples() if x.n > 1e-12}
    assert found.keys() == {k for k, n in want.items() if n / every > 1e-12} and all(abs(found[k] - want[k] / every) < 1e-9 for k in found)


def test_fences_that_do_not_end_are_text():
    assert pages.units("a\n```py\nx\n~~~\n```\nb") == ["a", "b"]
    assert pages.units("```x```\na\n```\nb") == ["```x```", "a", "```", "b"]
    assert pages.units("~~~\n```\na\n~~~\nc\n```") == ["c", "```"]


def test_viterbi_is_the_best_path():
    import itertools
    import math

    r = random.Random(2)
    model = {"emit": [[[math.log(r.random()) for _ in range(n)] for n in pages.VALUES] for _ in range(4)], "step": [[math.log(r.random()) for _ in range(4)] for _ in range(4)]}
    seen = [tuple(r.randrange(n) for n in pages.VALUES) for _ in range(5)]
    score = lambda p: sum(sum(model["emit"][s][f][v] for f, v in enumerate(x)) for s, x in zip(p, seen)) + sum(model["step"][a][b] for a, b in zip(p, p[1:]))
    assert tuple(pages.viterbi(seen, model)) == max(itertools.product(range(4), repeat=5), key=score)


# ---------------------------------------------------------------- origins
def body(k, n=30):
    r = random.Random(k)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    return "\n".join(f"{word()} = {word()}({word()}, {word()})" for i in range(n)) + "\n"


def origin_tables(spark, rows):
    """rows: node, repository, path, text, day"""
    files = spark.createDataFrame([(n, r, p, d and dt.datetime(2025, 1, d), "z") for n, r, p, _, d in rows] * 2, "node_id string, repository_name string, file_path string, created_at timestamp, reason string")
    return files, spark.createDataFrame([(n, t, "z") for n, _, _, t, _ in rows], "node_id string, content string, lines string")


def test_origins(spark):
    own = body(1)
    edited = own + "# patched for us, see below\n"
    rows = [
        ("orig", "lib_x", "src/a.py", own, 9), ("copy", "app", "pkg/lib_x/src/b.py", edited, 1), ("hand", "app", "src/integrations/lib_x/c.py", body(2), 1), ("gen", "app", "generated-sources/d.py", body(3), 1),
        ("mark", "app", "src/e.py", "# Code generated by tool. DO NOT EDIT.\n" + body(4), 1), ("says", "app", "src/f.py", "x = 1\n# Skips generated inputs\n" + body(5), 1), ("vend", "app", "src/vendor/g.py", body(6), 1),
        ("node", "app", "node_modules/q/h.js", "let a = 1\n", 1), ("data", "app", "src/i.py", "x = [" + ", ".join(str(i * 7919) for i in range(200)) + "]\n", 1), ("null", None, "src/j.py", body(7), 1), ("none", "app", "src/k.py", "", 1), ("gone", "app", "src/l.py", None, 1),
        ("same", "other", "src/m.py", own, 1), ("empty", "app", "vendor/lib_x/n.py", " \r\n", 1), ("never", "app", "src/o.py", body(8), None),
    ]
    files, texts = origin_tables(spark, rows)
    got = {r.node_id: r.reason for r in handwritten.file_origins(files, texts).collect()}
    # `same` was there before `orig`, whose repository `copy` names: it is the first, orig the copy of it
    assert got == {"orig": "taken over", "copy": "taken over", "hand": None, "gen": "generated", "mark": "generated", "says": None, "vend": None, "node": "taken over", "data": "data", "null": None, "none": None, "same": None, "empty": None, "never": None}
    assert handwritten.not_handwritten(files.where("false"), texts).collect() == []


def test_folders_that_sound_so_and_figures_are_no_marks(spark):
    table = "".join(f"RATE_{i} = {i * 3}\n" for i in range(12))
    paths = ["build/release.py", "out/report.py", "target/planner.py", "dist/split.py", "deps/api/graph.py", "external/api/client.py", "gen/x.py", "src/vendor/y.py", "third_party/z.py"]
    rows = [(p, "app", p, body(50 + i), 1) for i, p in enumerate(paths)] + [("digest", "app", "src/a.py", body(70) + "# digest abcdef1\n", 1), ("table", "app", "src/b.py", table, 1)]
    rows += [("tool", "app", "src/c.py", "# produced with openapi-generator; changes will be lost\n" + body(71), 1), ("numbered", "app", "src/d.py", "".join(f"def get_{i:03}(row):\n    return row[{i}]\n\n" for i in range(20)), 1)]
    assert {r.node_id for r in handwritten.not_handwritten(*origin_tables(spark, rows)).collect()} == {"tool", "numbered"}


def test_a_copy_whose_lines_stood_in_two_repositories_before_is_found(spark):
    own = body(90, 13)
    lines = own.split("\n")
    rows = [("ra", "ra", "src/a.py", "\n".join(lines[:6]) + "\n" + body(91), 1), ("rb", "rb", "src/b.py", own, 2), ("copy", "rc", "src/c.py", "\n".join(lines[:12]) + "\nour_own = 1\n", 3)]
    assert {r.node_id for r in handwritten.not_handwritten(*origin_tables(spark, rows)).collect()} == {"copy"}


def test_copies_of_files_that_many_hold_are_found(spark):
    common = "".join(f"from shared.library import name_{i}\n" for i in range(10))
    rows = [("a0", "early", "src/first.py", body(1000) + common, 1)]  # first with the common lines
    rows += [("orig", "lib_x", "src/x.py", body(1) + common, 2), ("short", "lib_x", "src/s.py", body(2, 4), 2)]
    rows += [(f"edited{i}", f"app{i}", "contrib/widget/x.py", body(1) + common + f"changed_for_{i} = {i}\n", 3) for i in range(60)]
    rows += [(f"named{i}", f"app{i}", "pkg/lib_x/x.py", f"changed_here_{i} = {i}\n" + body(1) + common, 3) for i in range(60)]
    rows += [(f"short{i}", f"app{i}", "contrib/s.py", body(2, 4), 3) for i in range(60)]
    rows += [(f"hand{i}", f"app{i}", "src/y.py", body(2000 + i) + common, 3) for i in range(60)]
    files, texts = origin_tables(spark, rows)
    wanted = {f"{kind}{i}" for kind in ("edited", "named", "short") for i in range(60)}
    assert {r.node_id for r in handwritten.not_handwritten(files, texts).collect()} == wanted
    # the same where hot lines are not compared one by one, but for those that a path names
    base = handwritten.line_table(files, texts)
    assert {r.node_id for r in handwritten.taken_over(base, hot_line=20).collect()} == {w for w in wanted if not w.startswith("named")} | {f"named{i}" for i in range(60)}


def test_hot_lines_are_compared_exactly(spark):
    """Files of lines that many hold: copies of one text are found, by name, by time and
    late among the holders; lines that stood in several texts before make no copy."""
    parts = [body(3000 + i, 4) for i in range(4)]
    widget = "".join(parts)
    rows = [(f"part{k}_{i}", f"p{k}_{i}", "src/p.py", parts[k] + body(4000 + 100 * k + i, 8), 1) for k in range(4) for i in range(8)]
    rows += [("mosaic", "own", "src/m.py", widget, 2)]  # all its lines stood somewhere before, in no text together
    rows += [(f"edited{i}", f"app{i}", "src/w.py", widget + f"changed_{i} = {i}\n", 3) for i in range(8)]
    rows += [("called", "app0", "pkg/own/w.py", f"called = 1\n{widget}", 1), ("unlike", "app1", "pkg/own/u.py", parts[0] + body(5000, 8), 1)]
    base = handwritten.line_table(*origin_tables(spark, rows)).cache()
    wanted = {f"edited{i}" for i in range(8)} | {"called"}
    for hot_line in (200, 3):
        assert {r.node_id for r in handwritten.taken_over(base, hot_line).collect()} == wanted
    base.unpersist()


def test_a_short_text_may_hold_a_longer_one(spark):
    own, short = body(1, 8), body(2, 4)
    rows = [("orig", "first", "src/a.py", own, 1), ("copy", "then", "src/b.py", own + "# patched here by us, see the ticket and ask before you change it\n", 2)]
    rows += [("short", "lib_x", "src/s.py", short, 1), ("named", "app", "pkg/lib_x/s.py", short + "changed = 1\n", 2)]
    assert {r.node_id for r in handwritten.not_handwritten(*origin_tables(spark, rows)).collect()} == {"copy", "named"}


def test_containment_as_brute_force(spark):
    r = random.Random(5)
    pool = [f"line number {i} " + "x" * r.randrange(30) for i in range(40)]
    forms = {i: r.sample(pool, r.randrange(1, 12)) for i in range(60)}
    rows = [(i, sum(map(len, t)), [(hash(x), len(x)) for x in t], s) for i, t in forms.items() for s in [r.choice((0.6, 0.8))]]
    df = spark.createDataFrame(rows, "form bigint, weight bigint, lines array<struct<h:bigint,w:int>>, share double")
    got = {(x.form, x.other) for x in handwritten.containment(df, 1000)[0].collect()}
    assert got == {(i, j) for i, w, _, s in rows for j, t in forms.items() if i != j and sum(len(x) for x in forms[i] if x in t) >= s * w}
