import random

import pytest

from lodestone import queries
from lodestone.operators import graph
from lodestone.sources.tables import table

EDGE = "source string, target string"


def edges(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], EDGE)


def random_pairs(seed, n=40, m=70):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def adjacency(pairs):
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(str(a), set()).add(str(b))
            adj.setdefault(str(b), set()).add(str(a))
    return adj


def reach(adj, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        for w in adj[todo.pop()]:
            if w not in seen and w != without:
                seen.add(w)
                todo.append(w)
    return seen


def test_star_centre_ranks_highest_and_ranks_sum_to_one(spark):
    got = {r.node: r.pagerank for r in graph.pagerank(edges(spark, [("c", x) for x in "abd"])).collect()}
    assert all(got["c"] > got[x] for x in "abd")
    assert abs(sum(got.values()) - 1) < 1e-6


def test_kcore_as_by_peeling(spark):
    pairs = random_pairs(3, 30, 110) + [(5, 5)]
    adj, core, k = {a: set(b) for a, b in adjacency(pairs).items()}, {}, 0
    while adj:
        low = [v for v in adj if len(adj[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for w in adj.pop(v):
                adj.get(w, set()).discard(v)
    assert {r.node: r.core for r in graph.kcore(edges(spark, pairs)).collect()} == core


@pytest.mark.parametrize(("seed", "m", "local"), [(5, 45, 10**6), (5, 45, 0), (6, 60, 0), (7, 38, 0)])
def test_components_and_articulation_points_by_removal(spark, seed, m, local):
    pairs = random_pairs(seed, 45, m)
    adj = adjacency(pairs)
    comp = {r.node: r.component for r in graph.components(edges(spark, pairs)).collect()}
    assert {v: min(reach(adj, v)) for v in adj} == {v: c for v, c in comp.items() if v in adj}
    points = {r.node for r in graph.articulation_points(edges(spark, pairs), local).collect() if r.is_articulation_point}
    expected = set()
    for v in adj:
        rest = reach(adj, v) - {v}
        if rest and reach({a: b - {v} for a, b in adj.items()}, next(iter(rest))) != rest:
            expected.add(v)
    assert points == expected


def modularity(adj, home):
    total = sum(map(len, adj.values()))
    parts = {}
    for v in adj:
        parts.setdefault(home[v], set()).add(v)
    return sum(sum(w in p for v in p for w in adj[v]) / total - (sum(len(adj[v]) for v in p) / total) ** 2 for p in parts.values())


def test_communities_by_rounds_are_as_good(spark):
    r = random.Random(2)
    pairs = [(f"{a}{i}", f"{a}{j}") for a in "abcd" for i in range(8) for j in range(i) if r.random() < 0.7] + [("a0", "b1"), ("b2", "c3"), ("c1", "d1"), ("d2", "a3"), ("y", "z")]
    adj = adjacency(pairs)
    one = {x.node: x.community for x in graph.communities(edges(spark, pairs)).collect()}
    rounds = {x.node: x.community for x in graph.communities(edges(spark, pairs), local_edges=0).collect()}
    assert rounds.keys() == adj.keys() and rounds["y"] == rounds["z"] == "y" and all(rounds[c] == c and c == min(v for v in rounds if rounds[v] == c) for c in set(rounds.values()))
    assert modularity(adj, rounds) > 0.95 * modularity(adj, one) > 0.5


def test_two_cliques_are_two_communities_and_components_stay_apart(spark):
    clique = lambda x: [(f"{x}{i}", f"{x}{j}") for i in range(5) for j in range(i)]
    got = {r.node: r.community for r in graph.communities(edges(spark, clique("a") + clique("b") + [("a0", "b0")] + [("z1", "z2")])).collect()}
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"}
    assert got["z1"] == got["z2"] == "z1"


def test_nulls_repeats_and_no_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "b"), ("a", None)], EDGE)
    assert {tuple(r) for r in graph.degrees(e).collect()} == {("a", 0, 1), ("b", 1, 0)}
    none = spark.createDataFrame([], EDGE)
    for f in (graph.degrees, graph.pagerank, graph.kcore, graph.components, graph.articulation_points, graph.communities):
        assert f(none).collect() == []
    assert graph.enriched(none, ["degree", "pagerank"], percentiles=True).collect() == []


@pytest.mark.parametrize("local", [10**6, 40, 0])
def test_enriched_is_the_same_whatever_one_task_takes(spark, local):
    pairs = random_pairs(4, 30, 60) + [("x1", "x2"), ("x2", "x1"), ("x2", "x3"), ("x4", "x4"), ("y1", "y2")]
    both = {(str(a), str(b)) for a, b in pairs}
    adj = {}
    for a, b in both:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    rank = dict.fromkeys(adj, 1 / len(adj))
    for _ in range(300):
        rank = {v: 0.15 / len(adj) + 0.85 * sum(rank[w] / len(adj[w]) for w in adj[v]) for v in adj}
    core = {r.node: r.core for r in graph.kcore(edges(spark, pairs)).collect()}
    rows = graph.enriched(edges(spark, pairs), ["degree", "kcore", "pagerank"], percentiles=True, local_pairs=local).collect()
    assert {r.node: (r.in_degree, r.out_degree, r.core) for r in rows} == {v: (sum(b == v for _, b in both), sum(a == v for a, _ in both), core[v]) for v in adj} and core["x4"] == 0
    assert sum(abs(r.pagerank - rank[r.node]) for r in rows) < 1e-5
    assert [r.pagerank_percentile for r in sorted(rows, key=lambda r: (r.pagerank, r.node))] == [round(100 * i / (len(rows) - 1), 2) for i in range(len(rows))]


def test_ranks_and_cores_of_a_graph_that_fits_one_task_take_no_rounds(spark):
    """Rounds of joins took up to 25 jobs for ranks alone."""
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    graph.enriched(edges(spark, [(i, i + 1) for i in range(40)]), ["degree", "kcore", "pagerank"]).collect()
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before < 30


@pytest.mark.parametrize("name", ["g2_pagerank_converged", "g6_enriched"])
def test_registered_ranks_have_converged(spark, data, name):
    adj = {}
    for a, b in queries._enrich_edges(lambda n: table(spark, data, n)).dropna().collect():
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    rank, moved = dict.fromkeys(adj, 1 / len(adj)), 1.0
    while moved > 1e-13:
        new = {v: 0.15 / len(adj) + 0.85 * sum(rank[w] / len(adj[w]) for w in adj[v]) for v in adj}
        rank, moved = new, sum(abs(new[v] - rank[v]) for v in adj)
    got = {r.node: r.pagerank for r in queries.QUERIES[name](spark, data).collect()}
    assert got.keys() == rank.keys() and sum(abs(got[v] - rank[v]) for v in rank) < 1e-5


@pytest.mark.parametrize("name", ["g2_pagerank_converged", "g3_communities", "g5_articulation_points", "g6_enriched"])
def test_every_node_of_an_active_edge_is_enriched(spark, data, name):
    active = queries.QUERIES["s5_active_edges"](spark, data).dropna().collect()
    rows = [r.node for r in queries.QUERIES[name](spark, data).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {x for r in active for x in r}


def test_containment_goes_as_deep_as_there_is_something(spark):
    e = spark.createDataFrame([(str(i), str(i + 1), "CONTAINS") for i in range(60)] + [("60", "3", "CONTAINS"), ("0", "x", "USES")], "source_id string, target_id string, relationship_type string")
    assert {r.node: r.depth for r in graph.containment(e, "0").collect()} == {str(i): i for i in range(1, 61)}
