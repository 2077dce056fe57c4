import datetime as dt
import random

from lodestone.operators.bitmaps import Bitmap
from lodestone.operators import references

T = lambda d, h=0: dt.datetime(2025, 1, 1) + dt.timedelta(days=d, hours=h)
EDGE = "edge_id string, source_id string, target_id string, loaded_at timestamp, record_id string, id string, at int"
NODE = "node_id string, loaded_at timestamp, deleted_at timestamp, space string, born string"


def run(spark, edges, nodes):
    e = spark.createDataFrame([(*x, "x", "y", 1) for x in edges], EDGE)
    n = spark.createDataFrame([(*x, "s", "b") for x in nodes], NODE)
    refs = references.references({"e": (e, "edge_id", "g")})
    lives = references.lifetimes({"g": [(n, "node_id", "deleted_at")]})
    return refs, lives


def brute(edges, nodes):
    first = {}
    for e in edges:
        if e[0] not in first or e[3] < first[e[0]][3]:
            first[e[0]] = e
    out = set()
    for k, s, t, at in first.values():
        for end, i in (("source", s), ("target", t)):
            if i is not None and not any(n == i and b is not None and at is not None and b <= at and (g is None or g > at) for n, b, g in nodes):
                out.add((k, end))
    return out


def test_as_by_brute_force_with_births_and_deaths_within_months(spark):
    r = random.Random(1)
    ids = [f"n{i}" for i in range(40)]
    nodes = [(r.choice(ids), T(r.randrange(200), r.randrange(24)), r.choice([None, T(r.randrange(200, 330))])) for _ in range(60)]
    nodes += [("edge", dt.datetime(2025, 2, 1), dt.datetime(2025, 4, 1)), ("n0", T(3), T(3)), nodes[0]]
    edges = [(f"e{i}", r.choice([*ids, None, "gone"]), "hub" if i % 3 else r.choice(ids), T(r.randrange(360), r.randrange(24))) for i in range(300)]
    edges += [("b1", "edge", "edge", dt.datetime(2025, 2, 1)), ("b2", "edge", None, dt.datetime(2025, 4, 1)), ("b3", "edge", None, dt.datetime(2025, 3, 31, 23, 59))]
    edges.append(("e0", edges[0][1], edges[0][2], T(400)))
    refs, lives = run(spark, edges, nodes)
    got = {(x.record_id, x.endpoint) for x in references.orphan_references(refs, lives, ranges=3).collect()}
    assert got == brute(edges, nodes)


def test_null_times_null_ids_and_empty_tables(spark):
    edges = [("a", "n", None, None), (None, "n", "x", T(5)), ("c", "n", "n", T(5))]
    nodes = [("n", T(1), None), (None, T(1), None), ("x", None, None)]
    refs, lives = run(spark, edges, nodes)
    got = {(x.record_id, x.endpoint) for x in references.orphan_references(refs, lives).collect()}
    assert got == {("a", "source"), (None, "target")}
    none, some = run(spark, [], []), run(spark, edges, nodes)
    assert references.orphan_references(*none).collect() == []
    assert references.orphan_references(none[0], some[1]).collect() == []
    assert references.orphan_references(some[0], none[1]).count() == 5


def test_bitmaps_are_sets_and_small():
    import numpy as np

    r = np.random.default_rng(5)
    shapes = [np.arange(200_000), np.arange(0, 300_000, 2), r.choice(400_000, 900, replace=False), np.array([], dtype=int), np.array([0, 65535, 65536, 131071]), np.concatenate((np.arange(5000), np.arange(70_000, 140_000, 3)))]
    for a in shapes:
        x = Bitmap.of(np.sort(a))
        assert (x.numbers() == np.sort(a)).all()
        for b in shapes:
            assert (x.and_not(Bitmap.of(np.sort(b))).numbers() == np.setdiff1d(a, b)).all()
    assert Bitmap.of(np.arange(10**6)).size() < 100 and Bitmap.of(np.sort(shapes[2])).size() == 1800 and Bitmap.of(np.arange(0, 65536, 2)).size() == 8192
