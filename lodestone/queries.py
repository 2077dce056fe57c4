"""Queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.values import ALLOWED, DEPENDENCY_KEYS, IRREGULAR, NOUN_ENDINGS, PACKAGE_ENDINGS, PACKAGES, SYNONYMS, UNCOUNTABLE, VERB_ENDINGS
from .operators import catalogue, chunks, classify, consistency, extract, graph, model, numbering, ranking, references, responses, versioning
from .plans.lineage import checkpoint_folder
from .sources import eventlog, files
from .sources.tables import table
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of the table reader under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REFERENCES = """
WITH e AS (
  SELECT 'graph_edges' AS table_name, edge_id AS record_id, min(loaded_at) AS moment, arg_min(source_id, loaded_at) AS s, arg_min(target_id, loaded_at) AS t FROM graph_edges GROUP BY edge_id
  UNION ALL SELECT 'relationships', identifier, min(loaded_at), arg_min(source_id, loaded_at), arg_min(target_id, loaded_at) FROM relationships GROUP BY identifier),
r AS (SELECT table_name, record_id, moment, 'source' AS endpoint, s AS id FROM e UNION ALL SELECT table_name, record_id, moment, 'target', t FROM e),
p AS (
  SELECT 'graph_edges' AS table_name, node_id AS id, loaded_at AS born, deleted_at AS gone FROM file_nodes
  UNION ALL SELECT 'graph_edges', node_id, loaded_at, deleted_at FROM dependency_nodes
  UNION ALL SELECT 'graph_edges', node_id, loaded_at, deleted_at FROM technology_nodes
  UNION ALL SELECT 'graph_edges', node_id, loaded_at, NULL FROM repositories
  UNION ALL SELECT 'relationships', identifier, loaded_at, disabled_at FROM elements),
o AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM p WHERE p.table_name = r.table_name AND p.id = r.id AND p.born <= r.moment AND (p.gone IS NULL OR p.gone > r.moment)) AS orphan FROM r WHERE id IS NOT NULL)
"""


@query(_REFERENCES + "SELECT table_name, record_id, endpoint FROM o WHERE orphan")
def p2_found(t):
    refs, lives = references.graph_references(t)
    return references.orphan_references(refs, lives).select("table_name", "record_id", "endpoint")


@query(
    _REFERENCES
    + """SELECT table_name, CAST(date_trunc('month', moment) AS DATE) AS month, count(*) AS "references", CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS orphans,
  sum(CASE WHEN orphan THEN 1 ELSE 0 END) / count(*) AS share FROM o GROUP BY 1, 2"""
)
def p2_report(t):
    return references.orphan_report(*references.graph_references(t))


# ---------------------------------------------------------------- graphs
_NODES = "SELECT node_id, active, repository_name FROM file_nodes UNION ALL SELECT node_id, active, repository_name FROM dependency_nodes UNION ALL SELECT node_id, active, repository_name FROM technology_nodes"


def _nodes(t):
    some = lambda n: t(n).select("node_id", "active", "repository_name")
    return some("file_nodes").unionByName(some("dependency_nodes")).unionByName(some("technology_nodes"))


def _edges(t):
    return t("graph_edges").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def _model_edges(t):
    return t("relationships").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def _enrich_edges(t):
    """The graph whose nodes are enriched: edges between active nodes."""
    return graph.active_edges(t("graph_edges"), _nodes(t))


@query(f"WITH n AS ({_NODES}), a AS (SELECT DISTINCT node_id FROM n WHERE active) SELECT source_id AS source, target_id AS target FROM graph_edges WHERE source_id IN (SELECT node_id FROM a) AND target_id IN (SELECT node_id FROM a)")
def s5_active_edges(t):
    return graph.active_edges(t("graph_edges"), _nodes(t))


@query(f"WITH n AS ({_NODES}), a AS (SELECT DISTINCT node_id FROM n WHERE active AND repository_name = 'atlas-platform') SELECT source_id AS source, target_id AS target FROM graph_edges WHERE source_id IN (SELECT node_id FROM a) AND target_id IN (SELECT node_id FROM a)")
def s5_repository_edges(t):
    return graph.active_edges(t("graph_edges"), _nodes(t), "atlas-platform")


_CLEAN = "SELECT DISTINCT source_id AS s, target_id AS t FROM {} WHERE source_id IS NOT NULL AND target_id IS NOT NULL"
_DEGREES = f"WITH e AS ({_CLEAN.format('graph_edges')}), d AS (SELECT s AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT t, 1, 0 FROM e), g AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM d GROUP BY node)"


@query(_DEGREES + " SELECT * FROM g")
def a1_degrees(t):
    return graph.degrees(_edges(t))


@query("WITH e AS (SELECT * FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), n AS (SELECT source_id AS node FROM e UNION SELECT target_id FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (CAST((SELECT count(*) FROM n) AS DOUBLE) * ((SELECT count(*) FROM n) - 1)), 6) AS density")
def a2_graph_facts(t):
    return graph.graph_facts(_edges(t))


def _pagerank_sql(rounds: int) -> str:
    both = f"e AS ({_CLEAN.format('relationships')}), b AS (SELECT s AS node, t AS other FROM e UNION SELECT t, s FROM e), d AS (SELECT node, count(*) AS deg FROM b GROUP BY node), n AS (SELECT count(*) AS n FROM d), r0 AS (SELECT node, 1.0 / n AS r FROM d, n)"
    steps = "".join(f", r{k} AS (SELECT b.other AS node, any_value(0.15 / n) + 0.85 * sum(r / deg) AS r FROM r{k - 1} JOIN b USING (node) JOIN d USING (node), n GROUP BY b.other)" for k in range(1, rounds + 1))
    return f"WITH {both}{steps} SELECT node, round(r, 9) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(6))
def g2_pagerank(t):
    """Six rounds, which SQL can unroll: holds the operator against SQL, no ranks to use."""
    return graph.pagerank(_model_edges(t), max_iter=6, tol=0).select("node", F.round("pagerank", 9).alias("pagerank"))


@query()
def g2_pagerank_converged(t):
    return graph.pagerank(_enrich_edges(t)).select("node", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH RECURSIVE e AS ({_CLEAN.format('relationships')}), b AS (SELECT s AS node, t AS other FROM e UNION SELECT t, s FROM e), r AS (SELECT node, node AS other FROM b UNION SELECT r.node, b.other FROM r JOIN b ON r.other = b.node) SELECT node, min(other) AS component FROM r GROUP BY node")
def g_components(t):
    return graph.components(_model_edges(t))


@query()
def g3_communities(t):
    return graph.communities(_enrich_edges(t))


def _kcore_sql(rounds: int) -> str:
    """H-indexes of the neighbours' values; more rounds than it takes change nothing."""
    steps = "".join(
        f", r{k} AS MATERIALIZED (SELECT node, max(least(v, n)) AS v FROM (SELECT b.node, r.v, row_number() OVER (PARTITION BY b.node ORDER BY r.v DESC) AS n FROM b JOIN r{k - 1} r ON r.node = b.other) GROUP BY node)" for k in range(1, rounds + 1)
    )
    return (
        f"WITH e AS ({_CLEAN.format('graph_edges')}), b AS MATERIALIZED (SELECT s AS node, t AS other FROM e WHERE s <> t UNION SELECT t, s FROM e WHERE s <> t), r0 AS (SELECT node, count(*) AS v FROM b GROUP BY node){steps} "
        f"SELECT node, CAST(v AS BIGINT) AS core FROM r{rounds} UNION ALL SELECT DISTINCT s, CAST(0 AS BIGINT) FROM e WHERE s = t AND s NOT IN (SELECT node FROM b)"
    )


@query(_kcore_sql(30))
def g4_kcore(t):
    return graph.kcore(_edges(t))


@query(
    f"WITH RECURSIVE n AS ({_NODES}), a AS (SELECT DISTINCT node_id FROM n WHERE active), d AS (SELECT source_id AS s, target_id AS t FROM graph_edges WHERE source_id IN (SELECT node_id FROM a) AND target_id IN (SELECT node_id FROM a)), "
    "e AS (SELECT s AS node, t AS other FROM d WHERE s <> t UNION SELECT t, s FROM d WHERE s <> t), r AS (SELECT node AS gone, min(other) AS at FROM e GROUP BY 1 HAVING count(*) > 1 UNION SELECT r.gone, e.other FROM r JOIN e ON e.node = r.at WHERE e.other <> r.gone), "
    "p AS (SELECT DISTINCT e.node FROM e WHERE e.node IN (SELECT gone FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.gone = e.node AND r.at = e.other)) SELECT node, node IN (SELECT node FROM p) AS is_articulation_point FROM (SELECT s AS node FROM d UNION SELECT t FROM d)"
)
def g5_articulation_points(t):
    return graph.articulation_points(_enrich_edges(t))


@query()
def g6_enriched(t):
    return graph.enriched(_enrich_edges(t), ["degree", "kcore", "pagerank"], percentiles=True)


@query(_DEGREES + ", c AS (SELECT in_degree AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY in_degree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g GROUP BY in_degree), k AS (SELECT count(*) AS m FROM g) SELECT g.node, g.in_degree, round(100.0 * (coalesce(b, 0) + (n - 1) / 2) / (m - 1), 2) AS percentile FROM g JOIN c ON g.in_degree = c.v, k")
def w2_degree_percentiles(t):
    return numbering.percentiles_by_mean_rank(graph.degrees(_edges(t)), "in_degree").select("node", "in_degree", "percentile")


@query("WITH RECURSIVE e AS (SELECT DISTINCT source_id AS node, target_id AS child FROM graph_edges WHERE relationship_type = 'CONTAINS' AND source_id IS NOT NULL AND target_id IS NOT NULL), r AS (SELECT child AS node, 1 AS depth FROM e WHERE node = 'repo_atlas-platform' UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON r.node = e.node WHERE r.depth < 50) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def containment_closure(t):
    return graph.containment(t("graph_edges"), "repo_atlas-platform")


# ---------------------------------------------------------------- ranking
_CAND = "SELECT node_id, max(name) AS name, max(pagerank) AS pagerank, max(louvain_community) AS louvain_community FROM candidates GROUP BY node_id"


def _candidates(t):
    return t("candidates").groupBy("node_id").agg(F.max("name").alias("name"), F.max("pagerank").alias("pagerank"), F.max("louvain_community").alias("louvain_community"))


@query(f"WITH c AS ({_CAND}) SELECT node_id, round(100.0 * (row_number() OVER (ORDER BY pagerank, node_id) - 1) / (count(*) OVER () - 1), 2) AS percentile FROM c")
def w1_pagerank_percentiles(t):
    return numbering.percentiles_by_place(_candidates(t), "pagerank", "node_id").select("node_id", "percentile")


@query(f"WITH c AS ({_CAND}) SELECT node_id, CAST((row_number() OVER (ORDER BY pagerank DESC, node_id) - 1) // 25 AS BIGINT) AS batch FROM c")
def w4_batches(t):
    return ranking.batches(_candidates(t), [F.col("pagerank").desc(), F.col("node_id").asc()], 25).select("node_id", "batch")


@query(f"WITH c AS ({_CAND}), r AS (SELECT *, row_number() OVER (ORDER BY pagerank DESC, node_id) AS k FROM c), f AS (SELECT *, min(k) OVER (PARTITION BY louvain_community) AS f FROM r) SELECT node_id, CAST((row_number() OVER (ORDER BY f, k) - 1) // 25 AS BIGINT) AS batch FROM f")
def w5_community_batches(t):
    return ranking.community_batches(_candidates(t), [F.col("pagerank").desc(), F.col("node_id").asc()], 25).select("node_id", "batch")


@query("SELECT node_id, dependency_name FROM (SELECT *, row_number() OVER (PARTITION BY repository_name, lower(dependency_name) ORDER BY record_id) AS k FROM dependency_nodes WHERE trim(dependency_name) <> '') WHERE k = 1")
def w6_first_dependency(t):
    rows = t("dependency_nodes").withColumn("low", F.lower("dependency_name")).select("repository_name", "low", "record_id", "node_id", "dependency_name")
    return ranking.first_of(rows, ["repository_name", "low"], [F.col("record_id")]).select("node_id", "dependency_name")


@query(f"WITH c AS ({_CAND}) SELECT node_id, pagerank FROM c WHERE pagerank >= 0.00001 ORDER BY pagerank DESC, node_id LIMIT 40")
def k1_top(t):
    return ranking.top_ranked(_candidates(t), top=40, least=0.00001).select("node_id", "pagerank")


@query(f"WITH c AS ({_CAND}), r AS (SELECT *, row_number() OVER (ORDER BY pagerank DESC, node_id) AS k, count(*) OVER () AS n FROM c) SELECT node_id, pagerank FROM r WHERE k <= greatest(1, CAST(floor(n * 10 / 100.0) AS BIGINT))")
def k1_percentile(t):
    return ranking.top_ranked(_candidates(t), percentile=90).select("node_id", "pagerank")


_INCLUDE, _EXCLUDE = ["publish", "release", "schedule", "convert"], ["test", "_", "audit"]
_LIKELY = "coalesce(name, '') <> '' AND NOT (" + " OR ".join(f"contains(lower(name), '{p}')" for p in _EXCLUDE) + ") AND (" + " OR ".join(f"contains(lower(name), '{p}')" for p in _INCLUDE) + ")"


@query(f"WITH c AS ({_CAND}) SELECT node_id, coalesce({_LIKELY}, false) AS likely FROM c")
def pred_likely(t):
    return _candidates(t).select("node_id", ranking.likely(F.col("name"), _INCLUDE, _EXCLUDE).alias("likely"))


@query(
    f"WITH c AS (SELECT *, coalesce({_LIKELY}, false) AS likely FROM ({_CAND})), l AS (SELECT * FROM c WHERE likely ORDER BY pagerank DESC, node_id LIMIT 15), o AS (SELECT * FROM c WHERE NOT likely ORDER BY pagerank DESC, node_id LIMIT 30), "
    "b AS (SELECT *, row_number() OVER (ORDER BY NOT likely, pagerank DESC, node_id) AS r FROM (SELECT * FROM l UNION ALL SELECT * FROM o)) SELECT node_id, likely FROM b WHERE r <= 30"
)
def k2_two_buckets(t):
    c = _candidates(t).withColumn("likely", ranking.likely(F.col("name"), _INCLUDE, _EXCLUDE))
    return ranking.two_buckets(c, "likely", 30).select("node_id", "likely")


@query(
    f"WITH c AS ({_CAND}), r AS (SELECT * FROM c WHERE node_id = louvain_community ORDER BY pagerank DESC, node_id LIMIT 30), o AS (SELECT * FROM c WHERE louvain_community IS NULL OR node_id <> louvain_community ORDER BY pagerank DESC, node_id LIMIT 10) "
    "SELECT node_id, pagerank FROM (SELECT * FROM r UNION ALL SELECT * FROM o) ORDER BY pagerank DESC, node_id LIMIT 30"
)
def k3_roots_and_best(t):
    return ranking.roots_and_best(_candidates(t), 30).select("node_id", "pagerank")


@query("SELECT node_id, round(pagerank, 4) AS pagerank, properties['methodName'] AS method FROM candidates WHERE list_contains(labels, 'Method') AND NOT list_contains(labels, 'Graph:Method')")
def pred_labels(t):
    return ranking.essential(ranking.with_labels(t("candidates"), ["Method"], ["Graph:Method"])).select("node_id", "pagerank", F.col("properties")["methodName"].alias("method"))


@query("SELECT node_id, name FROM candidates WHERE name <> '' AND NOT starts_with(name, '__')")
def pred_named(t):
    return ranking.named(t("candidates"), without="__").select("node_id", "name")


@query("SELECT node_id FROM candidates WHERE is_articulation_point")
def pred_cut_nodes(t):
    return ranking.cut_nodes(t("candidates")).select("node_id")


@query("SELECT node_id FROM candidates WHERE node_id = louvain_community OR is_articulation_point")
def pred_roots_or_cut_nodes(t):
    c = t("candidates")
    return ranking.in_communities(c, only_roots=True).select("node_id").unionByName(c.where("is_articulation_point and not coalesce(node_id = louvain_community, false)").select("node_id"))


@query(f"{_DEGREES}, c AS (SELECT DISTINCT target_id AS node_id FROM graph_edges WHERE target_id IS NOT NULL UNION SELECT DISTINCT node_id FROM file_nodes) SELECT c.node_id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM c LEFT JOIN g ON g.node = c.node_id")
def j1_with_metrics(t):
    ids = t("graph_edges").where("target_id is not null").select(F.col("target_id").alias("node_id")).unionByName(t("file_nodes").select("node_id")).distinct()
    return ranking.with_metrics(ids, graph.degrees(_edges(t)).withColumnRenamed("node", "node_id"))


# ---------------------------------------------------------------- agreement of runs and models
_RUNS = "SELECT DISTINCT event_type, CAST(date_trunc('week', ts) AS DATE) AS run, CAST(user_id AS VARCHAR) AS object FROM events"
_SCORES = f"WITH p AS ({_RUNS}), n AS (SELECT event_type, count(DISTINCT run) AS runs FROM p GROUP BY 1), o AS (SELECT event_type, object, count(*) AS k FROM p GROUP BY 1, 2), s AS (SELECT n.event_type, any_value(runs) AS runs, count(*) AS objects, CAST(sum(CASE WHEN k = runs THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM o JOIN n USING (event_type) GROUP BY 1), f AS (SELECT *, CASE WHEN runs < 2 THEN 1.0 ELSE stable / objects END AS score, objects - stable AS deviations FROM s)"


def _runs(t):
    return t("events").select("event_type", F.to_date(F.date_trunc("week", "ts")).alias("run"), F.col("user_id").cast("string").alias("object"))


@query(_SCORES + " SELECT * FROM f")
def u1_scores(t):
    return consistency.scores(_runs(t), ["event_type"])


@query(f"WITH p AS ({_RUNS}), a AS (SELECT event_type, list(DISTINCT run) AS e FROM p GROUP BY 1), o AS (SELECT event_type, object, count(*) AS k FROM p GROUP BY 1, 2) SELECT o.event_type, object, k AS present, len(e) - k AS missing FROM o JOIN a USING (event_type) WHERE k < len(e)")
def u2_inconsistencies(t):
    return consistency.inconsistencies(_runs(t), ["event_type"]).select("event_type", "object", F.size("present").cast("bigint").alias("present"), F.size("missing").cast("bigint").alias("missing"))


@query("WITH a AS (SELECT DISTINCT dependency_name AS o FROM dependency_nodes WHERE repository_name = 'atlas-platform'), b AS (SELECT DISTINCT dependency_name AS o FROM dependency_nodes WHERE repository_name <> 'atlas-platform'), x AS (SELECT count(*) AS n FROM a WHERE o IN (SELECT o FROM b)) SELECT n AS both, (SELECT count(*) FROM a) - n AS only_a, (SELECT count(*) FROM b) - n AS only_b, n / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - n) AS jaccard FROM x")
def u3_compared(t):
    d = t("dependency_nodes").select("repository_name", F.col("dependency_name").alias("object"))
    return consistency.compared(d.where("repository_name = 'atlas-platform'"), d.where("repository_name <> 'atlas-platform'"))


@query("WITH p AS (SELECT DISTINCT source, lang AS model, repository_name AS object FROM documents), n AS (SELECT source, count(DISTINCT model) AS models FROM p GROUP BY 1), o AS (SELECT source, object, count(*) AS k FROM p WHERE object IS NOT NULL GROUP BY 1, 2), g AS (SELECT n.source, any_value(models) AS models, count(*) AS objects, CAST(sum(CASE WHEN k = models THEN 1 ELSE 0 END) AS BIGINT) AS overlap, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_one FROM o JOIN n USING (source) GROUP BY 1) SELECT *, overlap / objects AS jaccard FROM g")
def u9_across_models(t):
    return consistency.across_models(t("documents").select("source", F.col("lang").alias("model"), F.col("repository_name").alias("object")), ["source"])


_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"WITH d AS ({_DAILY}) SELECT event_type, count(*) AS runs, round(var_pop(n), 6) AS variance, round(CASE WHEN count(*) < 2 OR avg(n) = 0 THEN 100.0 ELSE greatest(0.0, 100 - stddev_pop(n) / avg(n) * 100) END, 6) AS consistency FROM d GROUP BY 1")
def a10_stage_consistency(t):
    daily = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return consistency.stage_consistency(daily, ["event_type"], "n").withColumn("variance", F.round("variance", 6)).withColumn("consistency", F.round("consistency", 6))


# one run per month and kind of node: which repositories had nodes of which kind
_KIND_RUNS = "SELECT DISTINCT date_trunc('month', loaded_at) AS run, relationship_type || '_' || split_part(target_id, '_', 2) AS object FROM graph_edges WHERE target_id IS NOT NULL AND relationship_type IN ('USES', 'IMPLEMENTS', 'TESTS')"
_KINDS = f"WITH p AS ({_KIND_RUNS}), n AS (SELECT count(DISTINCT run) AS runs FROM p), o AS (SELECT object, count(*) AS k FROM p GROUP BY 1), g AS (SELECT split_part(object, '_', 1) AS kind, any_value(runs) AS runs, count(*) AS objects, CAST(sum(CASE WHEN k = runs THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM o, n WHERE runs >= 2 GROUP BY 1)"


def _kind_runs(t):
    e = t("graph_edges").where("target_id is not null and relationship_type in ('USES', 'IMPLEMENTS', 'TESTS')")
    return e.select(F.date_trunc("month", "loaded_at").alias("run"), F.concat_ws("_", "relationship_type", F.get(F.split("target_id", "_"), 1)).alias("object"))


@query(_KINDS + " SELECT kind, runs, objects, stable, stable / objects AS score, objects - stable AS deviations FROM g")
def a12_type_breakdown(t):
    return consistency.by_inferred_type(_kind_runs(t), consistency.type_of(F.col("object")))


@query(
    "WITH p AS (SELECT DISTINCT date_trunc('month', loaded_at) AS run, name AS object FROM elements WHERE name IS NOT NULL), n AS (SELECT count(DISTINCT run) AS runs FROM p), o AS (SELECT object, lower(object) AS l, count(*) AS k FROM p GROUP BY 1, 2), "
    "x AS (SELECT CASE WHEN contains(l, 'component') OR starts_with(l, 'ac_') THEN 'ApplicationComponent' WHEN contains(l, 'service') OR starts_with(l, 'as_') THEN 'ApplicationService' WHEN contains(l, 'data') OR starts_with(l, 'do_') THEN 'DataObject' WHEN contains(l, 'artifact') OR starts_with(l, 'art_') THEN 'Artifact' ELSE split_part(object, '_', 1) END AS kind, k FROM o) "
    "SELECT kind, any_value(runs) AS runs, count(*) AS objects, CAST(sum(CASE WHEN k = runs THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM x, n WHERE runs >= 2 GROUP BY 1"
)
def u6_element_types(t):
    rows = t("elements").select(F.date_trunc("month", "loaded_at").alias("run"), F.col("name").alias("object"))
    return consistency.by_inferred_type(rows, consistency.element_type_of(F.col("object"))).select("kind", "runs", "objects", "stable")


# documents as runs: a model is a language, a repository a source, a run a month; a run made the
# repositories that its documents name
_WITHIN_ROWS = "SELECT DISTINCT lang AS model, source AS repository, date_trunc('quarter', created_at) AS run, repository_name AS object FROM documents WHERE lang IS NOT NULL"
_WITHIN = f"""WITH p AS ({_WITHIN_ROWS}), m AS (SELECT model, repository, run, count(object) AS made FROM p GROUP BY ALL), n AS (SELECT model, repository, count(*) AS runs, var_pop(made) AS v FROM m GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT model, repository, object, count(*) AS k FROM p WHERE object IS NOT NULL GROUP BY ALL), g AS (SELECT model, repository, count(*) AS objects, CAST(sum(CASE WHEN k = runs THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM o JOIN n USING (model, repository) GROUP BY ALL),
w AS (SELECT model, repository, runs, coalesce(objects, 0) AS objects, coalesce(stable, 0) AS stable, v AS count_variance, CASE WHEN coalesce(objects, 0) = 0 THEN 100.0 ELSE 100.0 * stable / objects END AS consistency FROM n LEFT JOIN g USING (model, repository)),
d AS (SELECT event_type AS name, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), st AS (SELECT name, CASE WHEN count(*) < 2 OR avg(n) = 0 THEN 100.0 ELSE greatest(0.0, 100 - stddev_pop(n) / avg(n) * 100) END AS score FROM d GROUP BY 1),
kp AS ({_KIND_RUNS}), kn AS (SELECT count(DISTINCT run) AS runs FROM kp), ko AS (SELECT object, count(*) AS k FROM kp GROUP BY 1), kk AS (SELECT split_part(object, '_', 1) AS name, 100.0 * sum(CASE WHEN k = runs THEN 1 ELSE 0 END) / count(*) AS score FROM ko, kn GROUP BY 1),
loc AS (SELECT 'model' AS dimension, model AS name, avg(consistency) AS score FROM w GROUP BY model UNION ALL SELECT 'repository', repository, avg(consistency) FROM w GROUP BY repository UNION ALL SELECT 'stage', name, score FROM st UNION ALL SELECT 'object_type', name, score FROM kk)
"""


def _within_rows(t):
    return t("documents").where("lang is not null").select(F.col("lang").alias("model"), F.col("source").alias("repository"), F.date_trunc("quarter", "created_at").alias("run"), F.col("repository_name").alias("object"))


def _within(t):
    rows = _within_rows(t)
    runs = rows.distinct().groupBy("model", "repository", "run").agg(F.count("object").alias("made"))
    return consistency.within_models(rows, runs)


def _located(t):
    daily = t("events").groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    kinds = consistency.by_inferred_type(_kind_runs(t), consistency.type_of(F.col("object"))).select(F.col("kind").alias("name"), "score")
    return consistency.localised(_within(t), consistency.stage_consistency(daily, ["name"], "n"), kinds)


@query(_WITHIN + "SELECT model, repository, runs, objects, stable, round(count_variance, 6) AS count_variance, round(consistency, 6) AS consistency FROM w")
def u8_within_models(t):
    return _within(t).withColumn("count_variance", F.round("count_variance", 6)).withColumn("consistency", F.round("consistency", 6))


@query(_WITHIN + "SELECT name, round(score, 6) AS score FROM loc WHERE dimension = 'model'")
def a11_mean_by_model(t):
    return consistency.mean_consistency(_within(t), "model").withColumn("score", F.round("score", 6))


@query(_WITHIN + "SELECT dimension, name, round(score, 6) AS score FROM loc")
def u14_localised(t):
    return _located(t).withColumn("score", F.round("score", 6))


@query(_WITHIN + ", h AS (SELECT CASE dimension WHEN 'model' THEN 1 WHEN 'stage' THEN 2 ELSE 3 END AS group_no, name, score FROM loc WHERE dimension IN ('model', 'stage') OR dimension = 'object_type' AND name IN ('USES', 'TESTS')) SELECT group_no, name, round(score, 6) AS score, CASE WHEN score < 50 THEN 'high' ELSE 'medium' END AS severity FROM h WHERE score < 80 ORDER BY h.group_no, h.score, h.name LIMIT 10")
def k5_hotspots(t):
    return consistency.weak_spots(_located(t), ("USES", "TESTS")).withColumn("score", F.round("score", 6))


@query(_WITHIN + ", q AS (SELECT DISTINCT repository, model, object FROM p), qn AS (SELECT repository, count(DISTINCT model) AS models FROM q GROUP BY 1), qo AS (SELECT repository, object, count(*) AS k FROM q WHERE object IS NOT NULL GROUP BY ALL), qj AS (SELECT qn.repository, CASE WHEN count(object) = 0 THEN 1.0 ELSE sum(CASE WHEN k = models THEN 1 ELSE 0 END) / count(object) END AS jaccard FROM qn LEFT JOIN qo USING (repository) GROUP BY 1) SELECT round(avg(x), 6) AS overall FROM (SELECT consistency AS x FROM w UNION ALL SELECT jaccard * 100 FROM qj)")
def a21_overall(t):
    across = consistency.across_models(_within_rows(t).select("repository", "model", "object"), ["repository"])
    return consistency.overall_of(_within(t), across).withColumn("overall", F.round("overall", 6))


@query(f"WITH p AS ({_RUNS}), n AS (SELECT event_type, count(DISTINCT run) AS runs FROM p GROUP BY 1), o AS (SELECT event_type, object, count(*) AS k FROM p GROUP BY ALL), s AS (SELECT event_type, CASE WHEN k = runs THEN 'stable' ELSE 'deviating' END AS side, object FROM o JOIN n USING (event_type)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type, side ORDER BY object) AS INTEGER) AS place FROM s) SELECT event_type, side, place, object FROM r WHERE place <= 50")
def k7_stability_lists(t):
    return consistency.stability_lists(_runs(t), ["event_type"], 50).select("event_type", "side", "place", "object")


@query("WITH p AS (SELECT DISTINCT 's:m:r:' || CAST(month(ts) AS VARCHAR) AS run, event_type || '_' || CAST(user_id AS VARCHAR) AS object FROM events), n AS (SELECT count(DISTINCT run) AS n FROM p) SELECT object, count(*) AS present, any_value(n) - count(*) AS missing, count(*) / any_value(n) AS consistency, CAST(max(CAST(split_part(run, ':', 4) AS INTEGER)) AS INTEGER) AS last_iteration FROM p, n WHERE starts_with(object, 'click_') GROUP BY 1")
def u11_details(t):
    rows = t("events").select(F.concat(F.lit("s:m:r:"), F.month("ts").cast("string")).alias("run"), F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("object"))
    d = consistency.details(rows, consistency.type_of(F.col("object")), "click")
    return d.select("object", "present", "missing", "consistency", F.array_max(F.transform("present_runs", lambda r: r["iteration"])).alias("last_iteration"))


@query(_SCORES + " SELECT CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(deviations) AS BIGINT) AS deviations, (sum(objects) - sum(deviations)) / sum(objects) AS overall FROM f")
def a22_overall(t):
    return consistency.overall(consistency.scores(_runs(t), ["event_type"]))


@query(_SCORES + " (SELECT event_type, score, 'most' AS side FROM f ORDER BY score DESC, event_type LIMIT 2) UNION ALL (SELECT event_type, score, 'least' FROM f ORDER BY score, event_type LIMIT 2)")
def k8_extremes(t):
    return consistency.extremes(consistency.scores(_runs(t), ["event_type"]), "event_type", 2)


@query(_SCORES + " SELECT event_type, CASE WHEN score < 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM f WHERE score < 0.8")
def u10_recommendations(t):
    return consistency.recommendations(consistency.scores(_runs(t), ["event_type"]), "event_type").select("event_type", "priority")


@query("WITH p AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS run, CAST(user_id AS VARCHAR) AS object, event_type FROM events), a AS (SELECT object FROM p WHERE event_type = 'click' GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT run) FROM p WHERE event_type = 'click')), b AS (SELECT object FROM p WHERE event_type <> 'click' GROUP BY object HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM p WHERE event_type <> 'click')) SELECT object, 'newly stable' AS change FROM b WHERE object NOT IN (SELECT object FROM a) UNION ALL SELECT object, 'became unstable' FROM a WHERE object NOT IN (SELECT object FROM b)")
def u13_stability_change(t):
    e = t("events").select("event_type", F.to_date(F.date_trunc("week", "ts")).alias("run"), F.col("user_id").cast("string").alias("object"))
    return consistency.stability_change(e.where("event_type = 'click'"), e.where("event_type <> 'click'"))


@query("WITH a AS (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY 1), p AS (SELECT DISTINCT date_trunc('month', ts) AS run, CAST(user_id AS VARCHAR) AS object, event_type FROM events), s AS (SELECT side, count(*) AS objects, sum(CASE WHEN k = runs THEN 1 ELSE 0 END) AS stable FROM (SELECT event_type = 'click' AS side, object, count(DISTINCT run) AS k FROM p GROUP BY ALL) JOIN (SELECT event_type = 'click' AS side, count(DISTINCT run) AS runs FROM p GROUP BY 1) USING (side) GROUP BY 1), v AS (SELECT max(CASE WHEN side THEN stable / objects END) AS before, max(CASE WHEN NOT side THEN stable / objects END) AS after FROM s) SELECT before, after, CASE WHEN after >= 0.8 THEN 'accepted' WHEN after > before THEN 'better' ELSE 'not better' END AS verdict FROM v")
def u13_verdict(t):
    e = t("events").select("event_type", F.date_trunc("month", "ts").alias("run"), F.col("user_id").cast("string").alias("object"))
    return consistency.stability_verdict(e.where("event_type = 'click'"), e.where("event_type <> 'click'"))


@query(f"WITH p AS ({_RUNS}), r AS (SELECT DISTINCT run FROM p), o AS (SELECT unnest(['1', '2', '3']) AS object) SELECT object, run, EXISTS (SELECT 1 FROM p WHERE p.run = r.run AND p.object = o.object) AS present FROM r, o")
def u12_presence(t):
    return consistency.presence(_runs(t), ["1", "2", "3"])


# ---------------------------------------------------------------- model
_CURRENT = "SELECT identifier, arg_max(struct_pack(n := name, t := element_type, d := documentation, r := repository_name, e := enabled), struct_pack(a := loaded_at, b := enabled, c := name)) AS x, arg_max(properties, struct_pack(a := loaded_at, b := enabled, c := name)) AS pr FROM elements GROUP BY identifier"
_ELEMENTS = f"SELECT identifier, x.n AS name, x.t AS element_type, x.d AS documentation, x.r AS repository_name, x.e AS enabled, pr AS properties FROM ({_CURRENT})"
_TYPES = "(VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in model.ELEMENTS.items()) + ") AS ty(element_type, layer, aspect)"


def _second_words(elements):
    second = F.coalesce(F.get(F.split("name", " "), 1), F.lit(""))
    return elements.withColumn("name", F.when(F.col("name").isNotNull(), second)).withColumn("repository_name", F.left("repository_name", F.lit(1)))


def _model(t):
    return model.current(t("elements")), t("relationships")


@query(f"WITH e AS ({_ELEMENTS}) SELECT identifier, name FROM e WHERE enabled AND identifier NOT IN (SELECT source_id FROM relationships WHERE source_id IS NOT NULL UNION SELECT target_id FROM relationships WHERE target_id IS NOT NULL)")
def j3_without_relationships(t):
    return model.without_relationships(*_model(t)).select("identifier", "name")


def _gap(a: str, b: str) -> str:
    return f"SELECT identifier, lower('{a} without {b}') AS issue FROM y WHERE layer = '{a}' AND enabled AND NOT EXISTS (SELECT 1 FROM u JOIN y f ON f.identifier = u.far WHERE u.identifier = y.identifier AND f.layer = '{b}')"


@query(
    f"WITH e AS ({_ELEMENTS}), y AS (SELECT e.*, layer FROM e JOIN {_TYPES} USING (element_type)), u AS (SELECT source_id AS identifier, target_id AS far FROM relationships UNION ALL SELECT target_id, source_id FROM relationships) "
    + " UNION ALL ".join(_gap(a, b) for a, b in (("Business", "Application"), ("Application", "Technology"), ("Technology", "Application")))
)
def r5_layer_gaps(t):
    return model.layer_gaps(*_model(t))


@query("WITH r AS (SELECT DISTINCT identifier, source_id, target_id, relationship_type FROM relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL), k AS (SELECT *, min(identifier) OVER (PARTITION BY source_id, target_id, relationship_type) AS kept_id FROM r) SELECT identifier, kept_id FROM k WHERE identifier <> kept_id")
def r2_duplicate_relationships(t):
    return model.duplicate_relationships(t("relationships"))


@query("WITH g AS (SELECT source_id, target_id, list(DISTINCT relationship_type) AS k FROM relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT unnest([['Serving', 'Flow'], ['Access', 'Flow'], ['Realization', 'Serving']]) AS p) SELECT source_id, target_id, p[1] || '+' || p[2] AS pair FROM g, p WHERE list_contains(k, p[1]) AND list_contains(k, p[2])")
def a13_redundant_relationships(t):
    return model.redundant_relationships(t("relationships"))


@query(f"WITH e AS (SELECT * REPLACE (split_part(name, ' ', 2) AS name, left(repository_name, 1) AS repository_name) FROM ({_ELEMENTS}) WHERE enabled), k AS (SELECT identifier, first_value(identifier) OVER (PARTITION BY repository_name, element_type, name ORDER BY coalesce(TRY_CAST(properties['source_pagerank'] AS DOUBLE), 0) DESC, coalesce(length(documentation), 0) DESC, identifier) AS kept_id FROM e WHERE name IS NOT NULL) SELECT identifier, kept_id FROM k WHERE identifier <> kept_id")
def r1_equal_elements(t):
    """Over the second words of the names and the first letters of repositories, so that some repeat."""
    return model.equal_elements(_second_words(_model(t)[0]))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in table.items()) + "}"


def _normal_sql(x: str) -> str:
    """SQL of text.normal_name without lemmas."""
    y = f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"
    for article in ("the", "a", "an"):
        y = f"regexp_replace({y}, '^{article} ', '')"
    y = f"trim(regexp_replace({y}, '[_\\-\\s]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({y}, ' '), lambda w: coalesce({_map(SYNONYMS)}[w], w)), ' ')"


@query(
    f"WITH e AS ({_ELEMENTS}), r AS (SELECT DISTINCT element_type, {_normal_sql('name')} AS normal, name FROM e WHERE enabled AND name <> ''), n AS (SELECT element_type, normal AS name, count(*) AS spellings FROM r WHERE normal <> '' GROUP BY 1, 2), "
    "p AS (SELECT a.element_type, a.name, b.name AS other FROM n a JOIN n b ON a.element_type = b.element_type AND (length(a.name) < length(b.name) OR length(a.name) = length(b.name) AND a.name < b.name) WHERE length(a.name) >= 0.75 * length(b.name) - 1), s AS (SELECT *, 1 - levenshtein(name, other) / length(other) AS similarity FROM p) "
    "SELECT * FROM s WHERE similarity >= 0.75 UNION ALL SELECT element_type, name, name, 1.0 FROM n WHERE spellings > 1"
)
def r1_similar_elements(t):
    return model.similar_elements(_model(t)[0], 0.75, by=("element_type",))


@query(
    f"WITH e AS (SELECT * REPLACE (split_part(name, ' ', 2) AS name, left(repository_name, 1) AS repository_name) FROM ({_ELEMENTS})), k AS (SELECT identifier, first_value(identifier) OVER (PARTITION BY repository_name, element_type, name ORDER BY coalesce(TRY_CAST(properties['source_pagerank'] AS DOUBLE), 0) DESC, coalesce(length(documentation), 0) DESC, identifier) AS kept_id FROM e WHERE enabled AND name IS NOT NULL) "
    "SELECT e.identifier, e.enabled AND (k.kept_id IS NULL OR k.kept_id = e.identifier) AS enabled FROM e LEFT JOIN k USING (identifier)"
)
def r1b_disabled(t):
    e = _second_words(_model(t)[0])
    return model.disabled(e, model.equal_elements(e)).select("identifier", "enabled")


_ALLOWED_ASPECTS = "(VALUES " + ", ".join(f"('{r}', {list(x)}, {list(y)})" for r, (x, y) in model.RELATIONSHIPS.items()) + ") AS m(relationship_type, a, b)"


@query(
    f"WITH e AS ({_ELEMENTS}), y AS (SELECT e.*, aspect FROM e LEFT JOIN {_TYPES} USING (element_type)), c AS (SELECT r.identifier, CASE WHEN s.aspect IS NULL THEN 'unknown source type' WHEN t.aspect IS NULL THEN 'unknown target type' WHEN m.a IS NULL THEN 'unknown relationship type' "
    f"WHEN NOT list_contains(m.a, s.aspect) THEN 'source not allowed' WHEN NOT list_contains(m.b, t.aspect) THEN 'target not allowed' END AS reason FROM relationships r JOIN y s ON s.identifier = r.source_id JOIN y t ON t.identifier = r.target_id LEFT JOIN {_ALLOWED_ASPECTS} ON m.relationship_type = r.relationship_type) SELECT identifier, reason IS NULL AS valid, reason FROM c"
)
def j13_relationship_validity(t):
    e, r = _model(t)
    return model.relationship_validity(r, e)


@query(f"WITH e AS (SELECT identifier FROM ({_ELEMENTS})) SELECT identifier, source_id, target_id FROM relationships WHERE source_id IN (SELECT identifier FROM e) AND target_id IN (SELECT identifier FROM e)")
def s8_relationships(t):
    e, r = _model(t)
    return model.relationships_between(r, e).select("identifier", "source_id", "target_id")


@query(f"WITH e AS (SELECT identifier FROM ({_ELEMENTS}) WHERE enabled) SELECT count(*) AS relationships FROM relationships WHERE relationship_type IN ('Flow', 'Serving') AND source_id IN (SELECT identifier FROM e) AND target_id IN (SELECT identifier FROM e)")
def a14_flow_serving(t):
    return model.flow_serving(*_model(t))


_RULES = "(VALUES " + ", ".join(str(x) for x in responses.RULES) + ") AS ru(element_type, direction, other_type, relationship_type)"


@query(f"WITH e AS ({_ELEMENTS}) SELECT element_type, direction, other_type, relationship_type FROM {_RULES} WHERE other_type IN (SELECT element_type FROM e WHERE enabled AND repository_name = 'atlas-platform')")
def j15_applicable_rules(t):
    e = _model(t)[0].where("enabled and repository_name = 'atlas-platform'")
    return responses.applicable_rules(responses.relationship_rules(e.sparkSession), e).select("element_type", "direction", "other_type", "relationship_type")


# nodes stand for the elements that came from them
_PLACES = "(SELECT node_id FROM file_nodes UNION SELECT node_id FROM dependency_nodes UNION SELECT node_id FROM technology_nodes)"


@query(f"WITH p AS {_PLACES}, o AS (SELECT DISTINCT node_id FROM file_nodes WHERE subtype = 'python'), c AS (SELECT DISTINCT source_id, target_id, relationship_type AS k FROM graph_edges WHERE source_id IN (SELECT node_id FROM o) AND target_id IN (SELECT node_id FROM p)), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY target_id, k) AS n FROM c) SELECT source_id, target_id, CASE k WHEN 'CONTAINS' THEN 'Composition' WHEN 'CALLS' THEN 'Flow' WHEN 'IMPORTS' THEN 'Serving' WHEN 'USES' THEN 'Access' ELSE 'Association' END AS relationship_type FROM r WHERE n <= 5")
def j14_proposed(t):
    places = _nodes(t).select("node_id", F.col("node_id").alias("identifier")).distinct()
    orphans = t("file_nodes").where("subtype = 'python'").select(F.col("node_id").alias("identifier"))
    return model.proposed_relationships(orphans, t("graph_edges"), places)


@query(f"WITH e AS (SELECT DISTINCT node_id FROM ({_NODES}) WHERE active UNION SELECT node_id FROM repositories), j AS (SELECT DISTINCT source_id AS parent, target_id AS child FROM graph_edges WHERE relationship_type = 'CONTAINS' AND source_id IN (SELECT node_id FROM e) AND target_id IN (SELECT node_id FROM e)) SELECT parent, child FROM j WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = parent AND r.target_id = child) ORDER BY parent, child LIMIT 100")
def j7_contained_pairs(t):
    e = _nodes(t).where("active").select("node_id").unionByName(t("repositories").select("node_id")).distinct().select(F.col("node_id").alias("identifier"), F.lit(True).alias("enabled"))
    return model.contained_pairs(e, t("graph_edges"), t("relationships"), F.col("identifier"))


@query(
    f"WITH e AS (SELECT * FROM elements) SELECT identifier AS subject, 'repeated identifier' AS rule FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT identifier, 'source does not exist' FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.identifier = r.source_id) UNION ALL SELECT identifier, 'target does not exist' FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.identifier = r.target_id) "
    f"UNION ALL SELECT identifier, 'unknown element type' FROM e WHERE element_type NOT IN ({', '.join(repr(x) for x in model.ELEMENTS)}) UNION ALL SELECT identifier, 'unknown relationship type' FROM relationships WHERE relationship_type NOT IN ({', '.join(repr(x) for x in model.RELATIONSHIPS)}) "
    "UNION ALL SELECT identifier, 'element without name' FROM e WHERE trim(name) = '' OR name IS NULL UNION ALL SELECT name, 'element without identifier' FROM e WHERE identifier IS NULL OR trim(identifier) = ''"
)
def v1_violations(t):
    return model.violations(t("elements"), t("relationships"))


@query(f"WITH e AS (SELECT * FROM ({_ELEMENTS}) WHERE enabled) SELECT r.identifier, r.source_id, r.target_id FROM relationships r WHERE source_id IN (SELECT identifier FROM e) AND target_id IN (SELECT identifier FROM e)")
def s17_exported_relationships(t):
    return model.exported(*_model(t))[1].select("identifier", "source_id", "target_id")


@query(f"WITH e AS (SELECT * FROM ({_ELEMENTS}) WHERE enabled) SELECT element_type, count(*) AS elements FROM e GROUP BY 1")
def a3_count_by_type(t):
    return model.exported(*_model(t))[0].groupBy("element_type").agg(F.count(F.lit(1)).alias("elements"))


@query(f"WITH e AS ({_ELEMENTS}) SELECT 'element' AS part, count(*) AS parts FROM e WHERE enabled UNION ALL SELECT 'relationship', count(*) FROM relationships WHERE source_id IN (SELECT identifier FROM e WHERE enabled) AND target_id IN (SELECT identifier FROM e WHERE enabled)")
def s16_model_parts(t):
    return files.model_parts(*model.exported(*_model(t))).groupBy("part").agg(F.count("xml").alias("parts"))


# ---------------------------------------------------------------- files
_FILE_CLASS = r"""CASE WHEN contains(p, 'fixtures') THEN 'test' WHEN contains(p, 'tests') THEN 'test'
 WHEN n = 'makefile' OR n = 'dockerfile' THEN 'build' WHEN n LIKE '%.lock' THEN 'dependency' WHEN regexp_matches(n, '^test_.*\.py$') THEN 'test' ELSE r.file_type END"""
_FILE_SQL = rf"WITH f AS (SELECT node_id, file_path, lower(file_path) AS p, regexp_extract(lower(file_path), '[^/]*$') AS n FROM file_nodes), c AS (SELECT f.node_id, {_FILE_CLASS} AS found_type, regexp_extract(n, '\.[^.]*$') AS ext FROM f LEFT JOIN (SELECT extension, min(file_type) AS file_type FROM file_type_registry WHERE regexp_matches(extension, '^\.[a-z]{{1,4}}$') GROUP BY 1) r ON r.extension = regexp_extract(n, '\.[^.]*$'))"


@query(_FILE_SQL + " SELECT node_id, found_type, CASE WHEN found_type IS NOT NULL THEN NULL WHEN ext = '' THEN 'no_extension' ELSE 'unknown_extension' END AS reason FROM c")
def e1_classified(t):
    return classify.classified(t("file_nodes"), t("file_type_registry")).select("node_id", "found_type", "reason")


@query(_FILE_SQL + " SELECT CASE WHEN found_type IS NOT NULL THEN 'classified' WHEN ext = '' THEN 'no_extension' ELSE 'unknown_extension' END AS status, count(*) AS files FROM c GROUP BY 1")
def a18_classification_stats(t):
    done = classify.classified(t("file_nodes"), t("file_type_registry"))
    return done.groupBy(F.coalesce("reason", F.lit("classified")).alias("status")).agg(F.count(F.lit(1)).alias("files"))


@query(_FILE_SQL.replace("FROM file_type_registry WHERE", "FROM file_type_registry WHERE file_type <> 'docs' AND") + " SELECT ext AS extension, count(*) AS files FROM c WHERE found_type IS NULL AND ext <> '' GROUP BY 1")
def e5_unknown_suffixes(t):
    return classify.unknown_suffixes(classify.classified(t("file_nodes"), t("file_type_registry").where("file_type <> 'docs'")))


@query(
    "WITH s AS (SELECT DISTINCT node_type, unnest(from_json(input_sources, '{\"files\": [{\"type\": \"VARCHAR\", \"subtype\": \"VARCHAR\"}]}').files) AS f FROM extraction_config WHERE is_active) "
    "SELECT DISTINCT node_type, node_id FROM file_nodes JOIN s ON s.f.type = file_type AND (s.f.subtype = '*' OR s.f.subtype = subtype)"
)
def pred_matching_files(t):
    return classify.matching_files(t("file_nodes"), t("extraction_config"))


@query(
    r"""WITH f AS (SELECT repository_name, file_path, max(size_bytes) AS size FROM file_nodes GROUP BY 1, 2), p AS (SELECT *, string_split(file_path, '/') AS p FROM f), u AS (SELECT repository_name, size, p, unnest(range(1, len(p))) AS d FROM p),
r AS (SELECT repository_name, array_to_string(p[1:d], '/') AS path, size, CASE WHEN d = len(p) - 1 THEN 1 ELSE 0 END AS direct FROM u), g AS (SELECT repository_name, path, CAST(sum(direct) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1, 2),
k AS (SELECT repository_name, regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS folders FROM g WHERE contains(path, '/') GROUP BY 1, 2) SELECT g.repository_name, g.path, files, bytes, coalesce(folders, 0) AS folders FROM g LEFT JOIN k ON k.repository_name = g.repository_name AND k.parent = g.path"""
)
def a16_directories(t):
    return classify.directories(t("file_nodes")).select("repository_name", "path", "files", "bytes", "folders")


@query(
    r"""WITH f AS (SELECT DISTINCT repository_name, file_path FROM file_nodes), p AS (SELECT *, string_split(file_path, '/') AS p FROM f), d AS (SELECT DISTINCT repository_name, array_to_string(p[1:d], '/') AS path FROM (SELECT *, unnest(range(1, len(p))) AS d FROM p))
SELECT label, count(*) AS nodes FROM (SELECT DISTINCT 'Repository' AS label, repository_name, '' AS x FROM f UNION ALL SELECT 'Directory', repository_name, path FROM d UNION ALL SELECT 'File', repository_name, file_path FROM f) GROUP BY 1"""
)
def e15_structure(t):
    return classify.structure(t("file_nodes"))[0].groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


# every Python file with a test beside it, made of its path
_TESTED = r"""WITH f AS (SELECT repository_name, file_path, min(node_id) AS node_id FROM file_nodes WHERE file_path LIKE '%.py' GROUP BY 1, 2), g AS (SELECT repository_name, node_id, file_path, regexp_replace(file_path, '([^/]*)\.py$', 'test_\1.py') AS test FROM f WHERE NOT regexp_matches(file_path, '(^|/)test_[^/]*$|_test\.py$|\.(spec|test)')),
a AS (SELECT repository_name, file_path, node_id FROM f UNION ALL SELECT repository_name, test, 'test of ' || node_id FROM g), t AS (SELECT repository_name, min(node_id) AS test_id, file_path AS test FROM a WHERE starts_with(node_id, 'test of ') GROUP BY 1, 3) SELECT t.test_id, s.node_id AS source_id FROM t JOIN (SELECT repository_name, file_path, min(node_id) AS node_id FROM a GROUP BY 1, 2) s ON s.repository_name = t.repository_name AND s.file_path = regexp_replace(t.test, '(^|/)test_([^/]*)$', '\1\2')"""


@query(_TESTED)
def j11_test_targets(t):
    files_ = t("file_nodes").where("file_path like '%.py'").select("repository_name", "file_path", "node_id")
    plain = files_.where(~F.col("file_path").rlike(r"(^|/)test_[^/]*$|_test\.py$|\.(spec|test)"))
    tests = plain.select("repository_name", F.regexp_replace("file_path", r"([^/]*)\.py$", "test_$1.py").alias("file_path"), F.concat(F.lit("test of "), "node_id").alias("node_id"))
    return classify.test_targets(files_.unionByName(tests), tests).select("test_id", "source_id")


@query("SELECT count(DISTINCT file_type) AS types, count(DISTINCT subtype) AS subtypes, count(*) AS total FROM file_type_registry")
def a4_registry_facts(t):
    return versioning.registry_facts(t("file_type_registry"))


@query("SELECT node_id, CASE WHEN n = 'requirements.txt' OR n LIKE '%-requirements.txt' THEN 'requirements_txt' WHEN n = 'pyproject.toml' THEN 'pyproject_toml' WHEN n = 'package.json' THEN 'package_json' WHEN lower(subtype) = 'python' THEN 'python_ast' ELSE 'llm' END AS method FROM (SELECT *, regexp_extract(lower(file_path), '([^/]*)$', 1) AS n FROM file_nodes)")
def e6_methods(t):
    return t("file_nodes").select("node_id", extract.method_of(F.col("file_path"), F.col("subtype")).alias("method"))


@query("SELECT repository_name, count(DISTINCT file_path) AS files, count(DISTINCT file_type) AS types, sum(size_bytes) / 1048576.0 AS mb FROM (SELECT DISTINCT repository_name, file_path, file_type, size_bytes FROM file_nodes) GROUP BY 1")
def a17_repository_totals(t):
    f = t("file_nodes").select("repository_name", "file_path", "file_type", "size_bytes").distinct()
    return f.groupBy("repository_name").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("file_type").alias("types"), (F.sum("size_bytes") / 1048576.0).alias("mb"))


@query()
def e12_python_records(t):
    py = t("file_nodes").where("endswith(lower(file_path), '.py')").select("node_id").distinct()
    return extract.python_records(t("file_texts").join(py, "node_id", "left_semi"))


@query()
def e10_imported_packages(t):
    return extract.imported_packages(e12_python_records(t))


@query()
def e14_method_nodes(t):
    return extract.method_nodes(e12_python_records(t), t("file_nodes"))[0]


@query("SELECT node_id, lower(dependency_name) AS name, version FROM dependency_nodes WHERE regexp_full_match(dependency_name, '[A-Za-z0-9][A-Za-z0-9._-]*') AND regexp_full_match(version, '[0-9.]+')")
def e7_requirements(t):
    d = t("dependency_nodes").where(F.col("dependency_name").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z") & F.col("version").rlike(r"^[0-9.]+\z"))
    texts = d.select("node_id", F.concat(F.lit("# needed\n-r other.txt\n"), "dependency_name", F.lit("=="), "version", F.lit(" ; python_version > '3'\n")).alias("content"))
    return extract.requirements(texts).select("node_id", F.lower("name").alias("name"), "version")


@query()
def t5_chunks(t):
    return chunks.chunked(t("file_texts"), 200, None, 2).select("node_id", "chunk_no", "chunks", "start_line", "end_line")


@query("SELECT node_id, CAST(length(content) // 4 AS BIGINT) AS tokens, length(content) // 4 > 500 AS over FROM file_texts WHERE content IS NOT NULL")
def t1_token_estimates(t):
    n = text.token_estimate(F.col("content"))
    return t("file_texts").where("content is not null").select("node_id", n.alias("tokens"), (n > 500).alias("over"))


# ---------------------------------------------------------------- scalar functions
@query(r"SELECT node_id, 'extdep_' || repository_name || '_' || regexp_replace(replace(replace(lower(dependency_name), ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') AS id FROM dependency_nodes")
def f1_node_ids(t):
    return t("dependency_nodes").select("node_id", text.node_id("extdep", F.col("repository_name"), F.col("dependency_name")).alias("id"))


@query("SELECT edge_id, lower(relationship_type) || '_' || source_id || '_to_' || target_id AS a, relationship_type || '_' || source_id || '_' || target_id AS b, source_id || '_' || relationship_type || '_' || target_id AS c FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL")
def f2_edge_ids(t):
    args = (F.col("relationship_type"), F.col("source_id"), F.col("target_id"))
    e = t("graph_edges").where("source_id is not null and target_id is not null")
    return e.select("edge_id", text.edge_id(*args).alias("a"), text.event_edge_id(*args).alias("b"), text.graph_edge_id(*args).alias("c"))


@query(r"SELECT node_id, CASE WHEN starts_with(file_path, repository_name || '/') THEN file_path ELSE repository_name || '/' || file_path END AS path FROM file_nodes")
def f4_normal_paths(t):
    return t("file_nodes").select("node_id", text.normal_path(F.col("file_path"), F.col("repository_name")).alias("path"))


@query("SELECT node_id, split_part(node_id, '_', 2) AS repository FROM dependency_nodes WHERE node_id LIKE 'extdep\\_%' ESCAPE '\\'")
def f5_repository_of(t):
    return t("dependency_nodes").where("startswith(node_id, 'extdep_')").select("node_id", text.repository_of(F.col("node_id")).alias("repository"))


@query(r"WITH x AS (SELECT identifier, regexp_replace(replace(replace(replace(lower(name), ' ', '_'), '-', '_'), ':', '_'), '[^\p{L}\p{N}_]', '', 'g') AS y FROM elements WHERE name IS NOT NULL) SELECT identifier, CASE WHEN regexp_matches(y, '^[\p{L}_]') THEN y ELSE 'id_' || y END AS xml FROM x")
def f6_xml_names(t):
    return t("elements").where("name is not null").select("identifier", text.xml_name(F.col("name")).alias("xml"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS h, sha256('v1|' || text || '|bench:x') AS k FROM documents WHERE text IS NOT NULL")
def f11_hashes(t):
    return t("documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("h"), text.cache_key(F.lit("v1"), F.col("text"), None, F.lit("x")).alias("k"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END AS ratio FROM part")
def f15_similarity(t):
    p = t("part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("edits"), text.similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))


_NAMES = "SELECT identifier, name FROM elements WHERE name IS NOT NULL"


def _word_sql(sql: str) -> str:
    return f"WITH x AS (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS w FROM elements WHERE name IS NOT NULL UNION SELECT DISTINCT unnest(string_split(lower(text), ' ')) FROM documents WHERE text IS NOT NULL), y AS (SELECT w FROM x WHERE regexp_full_match(w, '[a-z]+')) SELECT w AS word, {sql} AS form FROM y"


def _words(t):
    """Different words of the names of elements and of documents."""
    each = lambda name, c: t(name).where(F.col(c).isNotNull()).select(F.explode(F.split(F.lower(c), " ")).alias("word"))
    return each("elements", "name").unionByName(each("documents", "text")).where(F.col("word").rlike(r"^[a-z]+\z")).distinct()


_SINGULAR = (
    f"CASE WHEN w IN ({', '.join(map(_text, UNCOUNTABLE))}) THEN w WHEN {_map(IRREGULAR)}[w] IS NOT NULL THEN {_map(IRREGULAR)}[w] WHEN regexp_matches(w, '[^aeiou]ies$') THEN left(w, -3) || 'y' "
    "WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, -2) WHEN regexp_matches(w, '[^s]s$') AND length(w) > 2 THEN left(w, -1) ELSE w END"
)
_LEMMA = "CASE WHEN length(w) <= 3 THEN w " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) > {len(e) + 2} THEN left(w, -{len(e)}) || '{n}'" for e, n in (*VERB_ENDINGS, *NOUN_ENDINGS)) + " ELSE w END"


@query(_word_sql(_SINGULAR))
def f7_singular(t):
    return _words(t).select("word", text.singular(F.col("word")).alias("form"))


@query(_word_sql(_LEMMA))
def f13_lemma(t):
    return _words(t).select("word", text.lemma(F.col("word")).alias("form"))


def _package_sql(x: str) -> str:
    base = "CASE " + " ".join(f"WHEN ends_with(lower({x}), {_text(e)}) THEN left({x}, length({x}) - {len(e)})" for e in PACKAGE_ENDINGS) + f" ELSE {x} END"
    return f"coalesce({_map(PACKAGES)}[lower({base})], {base})"


@query(f"SELECT node_id, {_package_sql('dependency_name')} AS package FROM dependency_nodes UNION ALL SELECT node_id, {_package_sql('tech_name')} FROM technology_nodes")
def f8_packages(t):
    one = lambda name, c: t(name).select("node_id", text.package_name(F.col(c)).alias("package"))
    return one("dependency_nodes", "dependency_name").unionByName(one("technology_nodes", "tech_name"))


@query(f"WITH x AS (SELECT identifier, list_filter(regexp_split_to_array(name, '[_\\s]+'), lambda v: v <> '') AS p FROM elements WHERE name IS NOT NULL), y AS (SELECT identifier, p, p[-1] AS v, lower(p[-1]) AS w FROM x), z AS (SELECT identifier, p, v, {_SINGULAR} AS s FROM y) SELECT identifier, array_to_string(list_transform(list_append(p[:-2], s), lambda v: upper(v[1]) || lower(v[2:])), '') AS concept FROM z")
def f9_concepts(t):
    return t("elements").where("name is not null").select("identifier", text.concept_name(F.col("name")).alias("concept"))


@query(f"SELECT record_id, 'extdep_' || repository_name || '_' || translate(lower(n), '- /', '___') AS node_id, n AS dependency_name FROM (SELECT record_id, repository_name, {_package_sql('dependency_name')} AS n FROM dependency_nodes)")
def f10_normalised_nodes(t):
    return responses.normalised_nodes(t("dependency_nodes"), "ExternalDependency", "dependency_name").select("record_id", "node_id", "dependency_name")


@query(f"SELECT identifier, {_normal_sql('name')} AS plain FROM elements")
def f14_normal_names(t):
    return t("elements").select("identifier", text.normal_name(F.col("name")).alias("plain"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS iso, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000) AS BIGINT) AS ms FROM events")
def f21_times(t):
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t("events").select("event_id", text.iso_time(F.col("ts").cast("timestamp")).alias("iso"), text.duration_ms(begin, F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT CAST(props->>'k' AS INTEGER) AS k, count(*) AS events FROM events GROUP BY 1")
def f18_json_field(t):
    j = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t("events").groupBy(F.get_json_object(text.json_of(j), "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("events"))


# ---------------------------------------------------------------- event log, versions, responses
def _log(t):
    return t("events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("activity"), F.col("ts").alias("timestamp"),
        F.create_map(F.lit("Run"), F.array(F.date_format("ts", "yyyy-MM")), F.lit("User"), F.array(F.col("user_id").cast("string"))).alias("objects"),
        F.create_map(F.lit("value"), F.round("value", 2).cast("string")).alias("attributes"),
    )


@query("SELECT strftime(ts, '%Y-%m') AS run, count(DISTINCT user_id) AS objects FROM events GROUP BY 1")
def s14_log_round_trip(t):
    log = _log(t)
    path = os.path.join(checkpoint_folder(log.sparkSession), f"log-{uuid.uuid4().hex}")
    eventlog.write_lines(log, path)
    back = eventlog.read_lines(log.sparkSession, path)
    return consistency.objects_by_run(back, "Run", "User").groupBy("run").agg(F.count("object").alias("objects"))


@query("SELECT CAST(user_id AS VARCHAR) AS object, 'User' AS kind, count(*) AS events FROM events GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m'), 'Run', count(*) FROM events GROUP BY 1")
def a7_object_catalogue(t):
    return eventlog.object_catalogue(_log(t))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE user_id = 7 AND starts_with(event_type, 'c')")
def pred_events_of_object(t):
    return eventlog.with_object(_log(t), "User", "7").where("startswith(activity, 'c')").select("event_id")


@query("SELECT DISTINCT unnest(['value', 'kind']) AS name FROM events")
def a7_attribute_names(t):
    log = _log(t).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("kind"), F.col("activity"))))
    return eventlog.attribute_names(log)


_MADE = "SELECT repository_name, min(created_at) AS at, list(DISTINCT node_id ORDER BY node_id) AS objects FROM technology_nodes GROUP BY 1"


@query(f"WITH m AS ({_MADE}) SELECT 'ExtractConfig' AS activity, repository_name AS repository, CAST(len(objects) AS BIGINT) AS objects, CAST(len(objects) AS VARCHAR) AS said FROM m")
def m11_config_events(t):
    made = t("technology_nodes").groupBy("repository_name").agg(F.min("created_at").cast("timestamp").alias("at"), F.collect_set("node_id").alias("objects"))
    none = F.lit(None).cast("array<string>")
    rows = made.select(F.lit("s").alias("session"), F.lit("r").alias("run"), F.col("repository_name").alias("repository"), F.lit("m").alias("model"), F.lit("Technology").alias("config"), "at", "objects", none.alias("edges"), none.alias("relationships"))
    e = eventlog.config_events(rows, True)
    return e.select("activity", F.col("objects")["Repository"][0].alias("repository"), F.size(F.col("objects")["GraphNode"]).cast("bigint").alias("objects"), F.col("attributes")["objects_created"].alias("said"))


@query("SELECT event_type AS model, CAST(event_id AS VARCHAR) AS event_id, CAST(props->>'k' AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges FROM events")
def a19_run_totals(t):
    stats = F.concat(F.lit('{"extraction": {"nodes_created": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    runs = t("events").select(F.col("event_id").cast("string").alias("event_id"), F.lit("CompleteRun").alias("activity"), F.create_map(F.lit("Model"), F.array("event_type")).alias("objects"), F.create_map(F.lit("stats"), stats).alias("attributes"))
    return eventlog.run_totals(runs)


@query("SELECT node_type AS name, sequence, enabled, coalesce(instruction, '') <> '' AS has_instruction FROM extraction_config WHERE is_active")
def m6_steps(t):
    return versioning.steps(t("extraction_config"), "node_type")


@query("SELECT id, enabled AND NOT (node_type = 'File' AND is_active) AS enabled FROM extraction_config")
def m6_disabled_step(t):
    return versioning.with_step(t("extraction_config"), "node_type", "File", False).select("id", "enabled")


@query("SELECT node_type, extraction_method, max(version) AS version FROM extraction_config WHERE is_active GROUP BY 1, 2")
def w7_active_versions(t):
    c = t("extraction_config").withColumn("key", F.concat_ws("|", "node_type", "extraction_method"))
    return versioning.active_versions(c, "key").select("node_type", "extraction_method", "version")


@query("SELECT id, node_type, version, is_active AND node_type <> 'Test' AS is_active, instruction FROM extraction_config UNION ALL SELECT (SELECT max(id) + 1 FROM extraction_config), node_type, version + 1, true, 'List tests.' FROM extraction_config WHERE node_type = 'Test' AND is_active")
def m5_new_version(t):
    return versioning.new_version(t("extraction_config"), "node_type", {"node_type": "Test", "instruction": "List tests."}).select("id", "node_type", "version", "is_active", "instruction")


@query("WITH o AS (SELECT edge_id, max({'m': loaded_at, 'k': relationship_type}) AS r FROM graph_edges WHERE loaded_at < TIMESTAMP '2025-04-01' GROUP BY 1), n AS (SELECT edge_id, max({'m': loaded_at, 'k': relationship_type}) AS r FROM graph_edges WHERE loaded_at >= TIMESTAMP '2025-04-01' GROUP BY 1) SELECT coalesce(n.edge_id, o.edge_id) AS edge_id, coalesce(n.r.k, o.r.k) AS relationship_type, coalesce(n.r.m, o.r.m) AS loaded_at FROM o FULL JOIN n ON n.edge_id = o.edge_id")
def m1_upserted_edges(t):
    e = t("graph_edges").select("edge_id", "loaded_at", "relationship_type")
    early = F.col("loaded_at") < F.lit("2025-04-01").cast("timestamp_ntz")
    base = versioning.upserted(e.where("false"), e.where(early), ["edge_id"])
    return versioning.upserted(base, e.where(~early), ["edge_id"]).select("edge_id", "relationship_type", "loaded_at")


@query("WITH x AS (SELECT identifier FROM elements WHERE enabled GROUP BY 1 HAVING count(*) > 1) SELECT identifier, loaded_at, enabled AND identifier NOT IN (SELECT identifier FROM x) AS enabled, CASE WHEN identifier IN (SELECT identifier FROM x) THEN 'twice' ELSE disabled_reason END AS disabled_reason FROM elements")
def m4_soft_disabled(t):
    twice = t("elements").where("enabled").groupBy("identifier").count().where("count > 1").select("identifier")
    return versioning.soft_disabled(t("elements"), twice, "twice").select("identifier", "loaded_at", "enabled", "disabled_reason")


@query("WITH g AS (SELECT DISTINCT node_id FROM file_nodes WHERE deleted_at IS NOT NULL) SELECT edge_id, loaded_at FROM graph_edges WHERE NOT EXISTS (SELECT 1 FROM g WHERE node_id = source_id) AND NOT EXISTS (SELECT 1 FROM g WHERE node_id = target_id)")
def m2_deleted(t):
    gone = t("file_nodes").where("deleted_at is not null").select("node_id")
    return versioning.deleted(t("file_nodes"), t("graph_edges"), gone)[1].select("edge_id", "loaded_at")


@query("SELECT max(id) + 1 AS next_id FROM extraction_config")
def a20_next_id(t):
    return versioning.next_id(t("extraction_config"))


@query("SELECT name, loaded_at FROM repositories ORDER BY cloned_at DESC, name LIMIT 10")
def k4_latest(t):
    return consistency.latest(t("repositories"), "cloned_at", 10, "name").select("name", "loaded_at")


_CATEGORY = "CASE WHEN lower(trim({0})) IN ({1}) THEN lower(trim({0})) ELSE '{2}' END"


def _category(field: str, x: str) -> str:
    allowed, default = ALLOWED[field]
    return _CATEGORY.format(x, ", ".join(map(_text, allowed)), default)


@query(f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY repository_name, translate(lower(dependency_name), '- /', '___') ORDER BY node_id, dependency_name) AS k FROM dependency_nodes WHERE trim(dependency_name) <> '' AND dependency_category <> '') SELECT 'extdep_' || repository_name || '_' || translate(lower(dependency_name), '- /', '___') AS node_id, node_id AS file_path, {_category('dependencyCategory', 'dependency_category')} AS category FROM d WHERE k = 1")
def e16_dependency_nodes(t):
    d = t("dependency_nodes").where("trim(dependency_name) <> '' and dependency_category <> ''")
    item = F.struct(F.col("dependency_name").alias("dependencyName"), F.col("dependency_category").alias("dependencyCategory"))
    keys = F.array(*map(F.lit, ("dependencies", *DEPENDENCY_KEYS)))
    key = F.get(keys, (F.col("record_id") % F.size(keys)).cast("int"))
    stub = d.select("repository_name", F.col("node_id").alias("file_path"), F.to_json(F.create_map(key, F.array(item))).alias("content"))
    return responses.extracted_nodes(stub, "dependencies")[0].select("node_id", "file_path", F.col("dependencyCategory").alias("category"))


@query("SELECT node_id, coalesce(tech_name, '') AS name, coalesce(tech_category, 'service') AS category FROM technology_nodes")
def e18_nodes(t):
    camel = F.to_json(F.struct(F.col("tech_name").alias("techName"), F.col("tech_category").alias("techCategory")))
    plain = F.to_json(F.struct(F.col("tech_name").alias("name"), F.col("tech_category").alias("category")))
    n = t("technology_nodes").select("node_id", responses.node_of("Technology", F.when(F.col("record_id") % 2 == 0, camel).otherwise(plain)).alias("n"))
    return n.select("node_id", "n.name", "n.category")


@query("SELECT count(text) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576.0, 2) AS mb FROM documents WHERE text IS NOT NULL")
def a23_stored_facts(t):
    return catalogue.stored_facts(t("documents").where("text is not null"), "text")


@query("SELECT identifier, name, confidence FROM relationships WHERE name IS NOT NULL AND name <> '' AND source_id IS NOT NULL AND identifier <> ''")
def l5_parsed_responses(t):
    item = F.struct("identifier", "name", F.col("source_id").alias("source"), "confidence")
    r = t("relationships").where("name is not null and name <> '' and source_id is not null")
    stub = r.select(F.concat(F.lit("Here it is:\n```json\n{\"elements\": "), F.to_json(F.array(item)), F.lit("}\n```\n")).alias("content"))
    return responses.parsed(stub, "elements").where("identifier <> ''").select("identifier", "name", "confidence")


@query(f"WITH c AS ({_CAND}) SELECT count(DISTINCT b) AS prompts FROM (SELECT (row_number() OVER (ORDER BY node_id) - 1) // 50 AS b FROM c)")
def l1_prompts(t):
    b = ranking.batches(_candidates(t), [F.col("node_id").asc()], 50)
    p = responses.batch_prompts(b, "List the components.")
    return responses.unanswered(p, p.where("false").select(F.lit("").alias("cache_key")), "m").agg(F.count("cache_key").alias("prompts"))


@query("SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def extension_stream_windows(t):
    e = t("events")
    return windows.run_once(e.sparkSession, e.inputFiles(), e.schema, windows.window_counts, "days").withColumn("value", F.round("value", 4))
