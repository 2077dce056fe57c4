"""Graphs as edge tables (source, target) and metrics of their nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, width
from .numbering import numbered, percentiles_by_mean_rank, percentiles_by_place

#: Rounds after which an iterative operator cuts its lineage.
CUT_EVERY = 4
#: Edges (both directions counted) up to which a component is searched by one task; a
#: larger one is searched by all.
LOCAL_EDGES = 500_000
#: The same for ranks and cores, which one task finds in arrays of numbers.
LOCAL_PAIRS = 2_000_000


def active_edges(edges: DataFrame, nodes: DataFrame, repository: str | None = None) -> DataFrame:
    """source, target of the edges whose two ends are active nodes (of the repository,
    if one is given).  Null ends match nothing; equal edges stay."""
    alive = nodes.where("active")
    if repository is not None:
        alive = alive.where(F.col("repository_name") == repository)
    ids = alive.select("node_id").distinct()
    some = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return some.join(ids, F.col("source") == ids["node_id"], "left_semi").join(ids, F.col("target") == ids["node_id"], "left_semi")


def clean(edges: DataFrame) -> DataFrame:
    return edges.where("source is not null and target is not null").select("source", "target").distinct()


def neighbours(edges: DataFrame, loops: bool = True) -> DataFrame:
    """node, other of the undirected simple graph: both directions, each pair once."""
    e = clean(edges)
    both = e.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other"))).distinct()
    return both if loops else both.where("node <> other")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree over distinct directed neighbours, 0 where none."""
    e = clean(edges)
    ends = e.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _numbered(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of the nodes by number (node, n), in the order of the names, and the pairs in
    numbers (a, b), partitioned by b and kept: rounds of an iteration move numbers only,
    and no pairs.  A partition that is lost is read again from the checkpoint."""
    names = cut(numbered(adj.select("node").distinct(), [F.col("node").asc()], "n"))
    pairs = adj.join(names.withColumnRenamed("n", "a"), "node").join(names.select(F.col("node").alias("other"), F.col("n").alias("b")), "other").select("a", "b")
    return names, _kept(cut(pairs))


def _pairs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of the nodes by number (node, n), in the order of the names, and the pairs of
    the undirected simple graph in numbers (a, b), both directions, with ``way``: 1 if
    there is an edge from a to b, 2 if from b to a, 3 if both.  Only numbers are made
    distinct, names are moved once."""
    e = cut(edges.where("source is not null and target is not null").select("source", "target"))
    names = cut(numbered(e.select(F.explode(F.array("source", "target")).alias("node")).distinct(), [F.col("node").asc()], "n"))
    at = lambda end, n: names.select(F.col("node").alias(end), F.col("n").alias(n))
    one = e.join(at("source", "s"), "source").join(at("target", "t"), "target").select("s", "t")
    ways = F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(1).alias("way")), F.struct(F.col("t").alias("a"), F.col("s").alias("b"), F.lit(2).alias("way")))
    pairs = one.select(F.explode(ways).alias("p")).select("p.*").groupBy("a", "b").agg(F.bit_or("way").alias("way"))
    return names, cut(pairs)


def _bins(names: DataFrame, pairs: DataFrame, local_pairs: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of whole components with a bin, of which each fits one task, and the pairs
    of the components that are larger than that (null if there are none)."""
    count = pairs.count()
    if count <= local_pairs:
        return pairs.withColumn("bin", F.lit(0)), None
    kept = _kept(pairs.select("a", "b"))
    label = _labels(names, kept)
    kept.unpersist()
    rows = cut(pairs.join(label, "b"))
    large = cut(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_pairs).select("c"))
    binned = rows.withColumn("bin", F.pmod(F.hash("c"), F.lit(-(-4 * count // max(local_pairs, 1)))))
    if large.isEmpty():
        return binned.drop("c"), None
    return binned.join(large, "c", "left_anti").drop("c"), rows.join(large, "c", "left_semi").drop("c")


def _kept(pairs: DataFrame) -> DataFrame:
    """The pairs partitioned by b and kept."""
    spark = pairs.sparkSession
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), width(spark, 1, pairs)), "b").persist(StorageLevel.MEMORY_AND_DISK)


def _cores(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Core numbers of the nodes 0 to n - 1 by peeling; pairs without loops, in the order
    of a.  A node's pairs are looked at once, when it goes."""
    degree = np.bincount(a, minlength=n)
    start = np.cumsum(degree) - degree
    now, core, gone = degree.copy(), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    left, k = np.arange(n), 0
    while len(left):
        k = max(k, int(now[left].min()))
        front = left[now[left] <= k]
        while len(front):
            core[front], gone[front] = k, True
            many = degree[front]
            near = b[np.repeat(start[front] + many - np.cumsum(many), many) + np.arange(many.sum())]
            near = near[~gone[near]]
            np.subtract.at(now, near, 1)
            near = np.unique(near)
            front = near[now[near] <= k]
        left = left[~gone[left]]
    return core


def _ranks(a: np.ndarray, b: np.ndarray, n: int, every: int, damping: float, max_iter: int, tol: float) -> np.ndarray:
    """Ranks of the nodes 0 to n - 1, a part of a graph of ``every`` nodes that no edge
    leaves; it may change by its share of tol."""
    degree = np.bincount(a, minlength=n)
    rank = np.full(n, 1.0 / every)
    for _ in range(max_iter):
        new = (1 - damping) / every + damping * np.bincount(a, weights=(rank / degree)[b], minlength=n)
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tol * n / every:
            break
    return rank


def _in_arrays(wanted: dict[str, dict], every: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, a = np.unique(g["a"].to_numpy(), return_inverse=True)
        b = np.searchsorted(ids, g["b"].to_numpy())
        order = np.argsort(a * len(ids) + b)  # sums are the same in every run
        a, b, way = a[order], b[order], g["way"].to_numpy()[order]
        out = {"n": ids}
        for name, given in wanted.items():
            if name == "degree":
                out["in_degree"] = np.bincount(a[way & 2 > 0], minlength=len(ids))
                out["out_degree"] = np.bincount(a[way & 1 > 0], minlength=len(ids))
            elif name == "kcore":
                out["core"] = _cores(a[a != b], b[a != b], len(ids))
            else:
                out["pagerank"] = _ranks(a, b, len(ids), every, **RANKS | given)
        return pd.DataFrame(out)

    return run


#: Columns of the metrics that _measured finds, and what pagerank takes if nothing is given.
MEASURED = {"degree": {"in_degree": "bigint", "out_degree": "bigint"}, "kcore": {"core": "bigint"}, "pagerank": {"pagerank": "double"}}
RANKS = {"damping": 0.85, "max_iter": 100, "tol": 1e-6}


def _measured(edges: DataFrame, wanted: dict[str, dict], local_pairs: int = LOCAL_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Names (node, n), and by n the columns of the wanted metrics (of MEASURED, with what
    is given for each).  No edge leaves a component, so components are measured apart:
    those that fit one task in arrays, several in one task, larger ones by all tasks,
    round by round."""
    names, pairs = _pairs(edges)
    every = names.count()
    bins, large = _bins(names, pairs, local_pairs)
    columns = {c: kind for name in wanted for c, kind in MEASURED[name].items()}
    found = bins.groupBy("bin").applyInPandas(_in_arrays(wanted, every), ", ".join(f"{c} {kind}" for c, kind in ({"n": "bigint"} | columns).items()))
    if large is not None:
        kept = _kept(large)
        out = cut(kept.select(F.col("b").alias("n")).distinct())
        for name, given in wanted.items():
            if name == "degree":
                more = large.groupBy("a").agg(F.sum((F.col("way").bitwiseAND(2) > 0).cast("bigint")).alias("in_degree"), F.sum((F.col("way").bitwiseAND(1) > 0).cast("bigint")).alias("out_degree"))
            elif name == "kcore":
                more = _cores_by_rounds(kept.where("a <> b"))
            else:
                more = _ranks_by_rounds(kept, out.count(), every, **RANKS | given)
            out = out.join(more.withColumnRenamed(more.columns[0], "n"), "n", "left")
        found = found.unionByName(cut(out.fillna(0)).select("n", *columns))  # of a loop only, no core
        kept.unpersist()
    return names, found


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """node, pagerank over the undirected simple graph; ends after max_iter rounds or
    when the ranks change by less than tol in all.  Every node has a neighbour, so no
    rank is lost."""
    names, found = _measured(edges, {"pagerank": {"damping": damping, "max_iter": max_iter, "tol": tol}}, local_pairs)
    return names.join(found, "n").select("node", "pagerank")


def _ranks_by_rounds(pairs: DataFrame, n: int, every: int, damping: float, max_iter: int, tol: float) -> DataFrame:
    """b, pagerank of a part of n of the graph's nodes, as ``_ranks``, whether it has
    ended asked every CUT_EVERY rounds."""
    degree = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("deg")))
    ranks = degree.select("b", "deg", F.lit(1.0 / every).alias("rank"))
    for k in range(max_iter):
        sent = pairs.join(ranks.select("b", (F.col("rank") / F.col("deg")).alias("share")), "b").groupBy("a").agg(F.sum("share").alias("got"))
        new = sent.withColumnRenamed("a", "b").join(degree, "b").select("b", "deg", (F.lit((1 - damping) / every) + damping * F.col("got")).alias("rank"))
        if (k + 1) % CUT_EVERY == 0 or k + 1 == max_iter:
            new = cut(new)
            if tol > 0 and k + 1 < max_iter:
                moved = new.join(ranks.select("b", F.col("rank").alias("old")), "b").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if moved < tol * n / every:
                    ranks = new
                    break
        ranks = new
    return ranks.select("b", F.col("rank").alias("pagerank"))


def kcore(edges: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """node, core: the largest k such that the node is in a subgraph of minimum degree
    k, loops aside."""
    names, found = _measured(edges, {"kcore": {}}, local_pairs)
    return names.join(found, "n").select("node", "core")


def _cores_by_rounds(pairs: DataFrame) -> DataFrame:
    """b, core.  Each node takes the H-index of its neighbours' values, from its degree
    on, until nothing changes.  Neighbours are counted by value, so a hub sends one row
    per distinct value into its window, not one per neighbour."""
    value = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("core")))
    down = Window.partitionBy("a").orderBy(F.col("core").desc()).rowsBetween(Window.unboundedPreceding, 0)
    changed = True
    while changed:  # values only fall, and never below 0
        before = value
        for _ in range(CUT_EVERY):
            counts = pairs.join(value, "b").groupBy("a", "core").agg(F.count(F.lit(1)).alias("n"))
            value = counts.withColumn("m", F.sum("n").over(down)).groupBy(F.col("a").alias("b")).agg(F.max(F.least("core", "m")).alias("core"))
        value = cut(value)
        changed = not value.join(before.withColumnRenamed("core", "old"), "b").where("core <> old").isEmpty()
    return value


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached.  Each round a node takes the
    least label around it and then its label's label, until no label changes."""
    adj = cut(neighbours(edges))
    if adj.isEmpty():
        return adj.select("node", F.col("other").alias("component"))
    names, pairs = _numbered(adj)
    label = _labels(names, pairs)
    pairs.unpersist()
    of = names.select(F.col("n").alias("c"), F.col("node").alias("component"))
    return names.join(label.withColumnRenamed("b", "n"), "n").join(of, "c").select("node", "component")


def _labels(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """b, c: the least number that each can reach."""
    label = cut(names.select(F.col("n").alias("b"), F.col("n").alias("c")))
    changed = True
    while changed:  # labels only fall
        near = pairs.join(label, "b").groupBy(F.col("a").alias("b")).agg(F.min("c").alias("near"))
        stepped = label.join(near, "b").select("b", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        jump = stepped.select(F.col("b").alias("c"), F.col("c").alias("further"))
        new = cut(stepped.join(jump, "c").select("b", "further", "old"))
        changed = not new.where("further <> old").isEmpty()
        label = new.select("b", F.col("further").alias("c"))
    return label


def _adjacency(g: pd.DataFrame) -> dict:
    adj: dict = {}
    for a, b in zip(g["node"], g["other"]):
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return adj


def _cut_nodes(g: pd.DataFrame) -> pd.DataFrame:
    adj = {k: sorted(v) for k, v in _adjacency(g).items()}
    order, low, points = {}, {}, set()
    for root in sorted(adj):
        if root in order:
            continue
        children = 0
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(adj[root]))]
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(adj[w])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if parent == root:
                        children += 1
                    elif low[v] >= order[parent]:
                        points.add(parent)
        if children > 1:
            points.add(root)
    nodes = sorted(set(g["node"]))
    return pd.DataFrame({"node": nodes, "is_articulation_point": [n in points for n in nodes]})


def _by_size(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame, DataFrame | None] | None:
    """Names of the nodes by number (in their order), and neighbours with their component
    in numbers: those of the components that fit one task, and those of the others (null
    if there are none).  Null without edges."""
    adj = cut(neighbours(edges))
    if adj.isEmpty():
        return None
    names, pairs = _numbered(adj)
    rows = cut(pairs.join(_labels(names, pairs), "b").select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("c").alias("component")))
    pairs.unpersist()
    large = cut(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_edges).select("component"))
    if large.isEmpty():
        return names, rows, None
    return names, rows.join(large, "component", "left_anti"), rows.join(large, "component", "left_semi").where("node <> other")


def articulation_points(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, is_articulation_point: whether the graph falls apart without the node.
    Components of up to ``local_edges`` edges are searched in parallel, each by one
    depth-first search in one task, larger ones by all tasks; both are exact."""
    parts = _by_size(edges, local_edges)
    if parts is None:
        return clean(edges).select(F.col("source").alias("node"), F.lit(False).alias("is_articulation_point"))
    names, small, large = parts
    found = small.groupBy("component").applyInPandas(_cut_nodes, "node bigint, is_articulation_point boolean")
    found = found if large is None else found.unionByName(_cut_nodes_by_rounds(large))
    return names.join(found.withColumnRenamed("node", "n"), "n").select("node", "is_articulation_point")


def _cut_nodes_by_rounds(adj: DataFrame) -> DataFrame:
    """Articulation points of components of any size.  A breadth-first tree gives every
    node its path from the root, round by round.  An edge outside the tree closes a
    cycle: the two paths from where they part.  Tree edges of one cycle belong to one
    block, so linking them makes blocks the components of tree edges (each named by its
    lower node).  A node is an articulation point if an edge to a child is in another
    block than the edge to its parent, the root if its children's are in several."""
    adj = cut(adj.select("node", "other", "component"))
    front = adj.select("component").distinct().select(F.col("component").alias("node"), F.array("component").alias("path"))
    tree = front = cut(front)
    while not front.isEmpty():
        step = front.select("node").join(adj, "node").groupBy(F.col("other").alias("node")).agg(F.min("node").alias("parent")).join(tree.select("node"), "node", "left_anti")
        front = cut(step.join(front.select(F.col("node").alias("parent"), "path"), "parent").select("node", F.concat("path", F.array("node")).alias("path")))
        tree = tree.unionByName(front)
    tree = cut(tree)
    ends = adj.where("node < other").select("node", "other")
    ends = ends.join(tree.select("node", F.col("path").alias("a")), "node").join(tree.select(F.col("node").alias("other"), F.col("path").alias("b")), "other")
    up = lambda c: F.get(c, F.size(c) - 2)
    ends = ends.where(~(F.coalesce(up(F.col("a")), F.lit(-1)) == F.col("other")) & ~(F.coalesce(up(F.col("b")), F.lit(-1)) == F.col("node")))
    common = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    ends = ends.withColumn("common", common)
    below = lambda c: F.slice(c, F.col("common") + 1, F.greatest(F.size(c) - F.col("common"), F.lit(0)))
    pairs = lambda c: F.filter(F.arrays_zip(c.alias("source"), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))).alias("target")), lambda x: x["target"].isNotNull())
    ends = ends.withColumn("x", below(F.col("a"))).withColumn("y", below(F.col("b")))
    top = F.array(F.struct(F.get("x", F.lit(0)).alias("source"), F.get("y", F.lit(0)).alias("target")))
    links = ends.select(F.explode(F.concat(pairs(F.col("x")), pairs(F.col("y")), top)).alias("l")).select("l.source", "l.target").distinct()
    block = components(links).select("node", F.col("component").alias("block"))
    edge = tree.join(block, "node", "left").select("node", F.size("path").alias("depth"), up(F.col("path")).alias("parent"), F.coalesce("block", "node").alias("block"))
    edge = cut(edge)
    own = edge.select(F.col("node").alias("parent"), F.col("depth").alias("at"), F.col("block").alias("own"))
    g = edge.where("parent is not null").join(own, "parent").groupBy(F.col("parent").alias("node"), "at").agg(F.countDistinct("block").alias("blocks"), F.max(F.col("block") != F.col("own")).alias("apart"))
    points = g.where("at = 1 and blocks > 1 or at > 1 and apart").select("node", F.lit(True).alias("is_articulation_point"))
    return edge.select("node").join(points, "node", "left").select("node", F.coalesce("is_articulation_point", F.lit(False)).alias("is_articulation_point"))


def _louvain(resolution: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        adj = {k: {n: 1.0 for n in v} for k, v in _adjacency(g).items()}
        nodes = sorted(set(g["node"]))
        home = {n: n for n in nodes}
        loops: dict = {}
        while True:
            total = sum(sum(v.values()) for v in adj.values()) + 2 * sum(loops.values())
            if total == 0:
                break
            names = sorted(adj)
            comm = {n: n for n in names}
            weight = {n: sum(adj[n].values()) + 2 * loops.get(n, 0) for n in names}
            size = dict(weight)
            moved_ever, moved = False, True
            while moved:
                moved = False
                for n in names:
                    near: dict = {}
                    for m, w in adj[n].items():
                        near[comm[m]] = near.get(comm[m], 0.0) + w
                    old = comm[n]
                    size[old] -= weight[n]
                    gain = lambda c: near.get(c, 0.0) - resolution * size[c] * weight[n] / total  # noqa: E731, B023
                    best, most = old, gain(old)
                    for c in sorted(near):
                        x = gain(c)
                        if x > most + 1e-12:
                            best, most = c, x
                    size[best] += weight[n]
                    if best != old:
                        comm[n] = best
                        moved = moved_ever = True
            if not moved_ever:
                break
            home = {n: comm[home[n]] for n in nodes}
            merged: dict = {c: {} for c in set(comm.values())}
            inner: dict = {}
            for n in names:
                inner[comm[n]] = inner.get(comm[n], 0) + loops.get(n, 0)
                for m, w in adj[n].items():
                    if comm[m] == comm[n]:
                        inner[comm[n]] += w / 2
                    else:
                        merged[comm[n]][comm[m]] = merged[comm[n]].get(comm[m], 0.0) + w
            adj, loops = merged, inner
        least: dict = {}
        for n in nodes:
            least.setdefault(home[n], n)
        return pd.DataFrame({"node": nodes, "community": [least[home[n]] for n in nodes]})

    return run


def communities(edges: DataFrame, resolution: float = 1.0, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, community (its least node): modularity by local moves, repeated on the merged
    graph.  Components of up to ``local_edges`` edges are taken by one task each, their
    nodes in the order of the ids, lowest community on ties; in larger ones all nodes
    move at once, round by round (_communities_by_rounds).  No community reaches across
    components."""
    parts = _by_size(edges, local_edges)
    if parts is None:
        return clean(edges).select(F.col("source").alias("node"), F.col("target").alias("community"))
    names, small, large = parts
    found = small.groupBy("component").applyInPandas(_louvain(resolution), "node bigint, community bigint")
    found = found if large is None else found.unionByName(_communities_by_rounds(large, resolution))
    of = names.select(F.col("n").alias("c"), F.col("node").alias("community"))
    return names.join(found.select(F.col("node").alias("n"), F.col("community").alias("c")), "n").join(of, "c").select("node", "community")


def _modularity(weights: DataFrame, degree: DataFrame, home: DataFrame, total: float, resolution: float) -> float:
    """Of the partition ``home`` (node, c); ``degree``: node, k, inner (weight of loops)."""
    at = home.withColumnRenamed("node", "other").withColumnRenamed("c", "d")
    within = weights.join(home, "node").join(at, "other").where("c = d").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x"))
    sums = degree.join(home, "node").groupBy("c").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    own = sums.agg(F.sum(2 * F.col("inner")).alias("y"), F.sum((F.col("k") / total) ** 2).alias("z"))
    one = lambda df: df.withColumn("one", F.lit(1))
    r = one(within).join(one(own), "one").first()
    return (r["x"] + r["y"]) / total - resolution * r["z"]


def _communities_by_rounds(adj: DataFrame, resolution: float) -> DataFrame:
    """Each round every node looks for the community around it that it adds most to; in
    even rounds only moves to a lower community are made, in odd ones to a higher, so
    that two nodes do not change places for ever.  Rounds end when none moves either
    way, or when they raise modularity no more; the best partition is kept and its
    communities become the nodes of the next graph, until nothing is merged."""
    weights = cut(adj.select("node", "other", F.lit(1.0).alias("w")))
    home = cut(adj.select("node").distinct().withColumn("c", F.col("node")))
    inner = home.select("node", F.lit(0.0).alias("inner"))
    total = float(weights.agg(F.sum("w")).first()[0])
    while True:
        degree = weights.groupBy("node").agg(F.sum("w").alias("s"))
        degree = cut(inner.join(degree, "node", "left").select("node", "inner", (F.coalesce("s", F.lit(0.0)) + 2 * F.col("inner")).alias("k")))
        own = cut(degree.select("node", F.col("node").alias("c")))
        best, most = own, _modularity(weights, degree, own, total, resolution)
        still = turn = worse = 0
        while still < 2:
            near = weights.join(own.select(F.col("node").alias("other"), "c"), "other").groupBy("node", "c").agg(F.sum("w").alias("w"))
            tries = near.unionByName(own.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
            sums = own.join(degree, "node").groupBy("c").agg(F.sum("k").alias("all"))
            rated = tries.join(sums, "c").join(degree.select("node", "k"), "node").join(own.withColumnRenamed("c", "own"), "node")
            gain = F.col("w") - resolution * (F.col("all") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) * F.col("k") / total
            g = rated.withColumn("gain", gain).groupBy("node", "own").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("to"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            way = F.col("to.c") < F.col("own") if turn % 2 == 0 else F.col("to.c") > F.col("own")
            goes = (-F.col("to.loss") > F.col("stay") + 1e-12) & way
            new = cut(g.select("node", F.when(goes, F.col("to.c")).otherwise(F.col("own")).alias("c"), goes.alias("moved")))
            turn += 1
            if new.where("moved").isEmpty():
                still += 1
                continue
            still, own = 0, new.drop("moved")
            now = _modularity(weights, degree, own, total, resolution)
            if now > most + 1e-9:
                best, most, worse = own, now, 0
            else:
                worse += 1
                if worse == 2:
                    break
        if best.where("node <> c").isEmpty():
            break
        home = cut(home.withColumnRenamed("c", "at").join(best.select(F.col("node").alias("at"), "c"), "at").select("node", "c"))
        to = best.select(F.col("node").alias("other"), F.col("c").alias("d"))
        merged = cut(weights.join(best, "node").join(to, "other").groupBy("c", "d").agg(F.sum("w").alias("w")))
        loops = degree.join(best, "node").groupBy("c").agg(F.sum("inner").alias("inner"))
        kept = merged.where("c = d").select("c", (F.col("w") / 2).alias("more"))
        inner = loops.join(kept, "c", "left").select(F.col("c").alias("node"), (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner"))
        weights = merged.where("c <> d").select(F.col("c").alias("node"), F.col("d").alias("other"), "w")
    least = home.groupBy("c").agg(F.min("node").alias("community"))
    return home.join(least, "c").select("node", "community")


METRICS = {
    "degree": lambda e, p: degrees(e),
    "pagerank": lambda e, p: pagerank(e, **p),
    "kcore": lambda e, p: kcore(e, **p),
    "articulation_points": lambda e, p: articulation_points(e),
    "louvain": lambda e, p: communities(e, **p),
}


def enriched(edges: DataFrame, algorithms: list[str], params: dict | None = None, percentiles: bool = False, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """One row per node with the columns of the named algorithms, and percentiles of
    pagerank (ties by node) and core and degrees (ties averaged) if asked for.  An
    unknown name is an error; no edges give no rows."""
    given = {name: {k: v for k, v in (params or {}).get(name, {}).items() if k != "description"} for name in algorithms}
    other = {name: METRICS[name](edges, given[name]) for name in algorithms if name not in MEASURED}
    names, out = _measured(edges, {name: given[name] for name in algorithms if name in MEASURED}, local_pairs)
    columns = ["node"] + [c for name in given for c in (MEASURED[name] if name in MEASURED else other[name].columns[1:])]
    if percentiles:
        out = cut(out)  # numbers are in the order of the names
        for c in ("core", "in_degree", "out_degree"):
            if c in out.columns:
                out = percentiles_by_mean_rank(out, c, f"{c}_percentile")
                columns = [c] + [x for x in columns if x != c] + [f"{c}_percentile"]
        if "pagerank" in out.columns:
            out = percentiles_by_place(out, "pagerank", "n", "pagerank_percentile")
            columns.append("pagerank_percentile")
    out = names.join(out, "n").drop("n")
    for found in other.values():
        out = out.join(found, "node", "left")
    return out.select(*columns)


def graph_facts(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges (equal ones counted), density (null up to one node)."""
    e = edges.where("source is not null and target is not null")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    count = e.agg(F.count(F.lit(1)).alias("edges"))
    one = nodes.withColumn("one", F.lit(1)).join(count.withColumn("one", F.lit(1)), "one").drop("one")
    return one.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1)), 6)))


def containment(edges: DataFrame, root: str) -> DataFrame:
    """node, depth of what the root contains, directly or through others, by breadth-first
    rounds over CONTAINS edges until nothing new is found; a node keeps its least depth."""
    e = cut(edges.where("relationship_type = 'CONTAINS'").select(F.col("source_id").alias("node"), F.col("target_id").alias("child")).where("node is not null and child is not null").distinct())
    seen = cut(e.where(F.col("node") == root).select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(1)))
    front, depth = seen, 1
    while not front.isEmpty():
        depth += 1
        front = cut(front.join(e, "node").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.unionByName(front))
    return seen
