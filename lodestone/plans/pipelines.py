"""Whole runs: registered refine steps, and the generate phase of one element type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, model, ranking, responses
from .lineage import cut

#: Refine steps by name: (elements, relationships, params) -> findings.
REFINE: dict[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {
    "duplicate_elements": lambda e, r, p: model.equal_elements(e),
    "similar_elements": lambda e, r, p: model.similar_elements(e, p.get("fuzzy", 0.85)),
    "duplicate_relationships": lambda e, r, p: model.duplicate_relationships(r),
    "redundant_relationships": lambda e, r, p: model.redundant_relationships(r),
    "orphan_elements": lambda e, r, p: model.orphan_actions(e, r, p.get("importance"), p.get("least", 0.0), p.get("disable", False)),
    "cross_layer": lambda e, r, p: model.layer_gaps(e, r),
    "structural_consistency": lambda e, r, p: model.contained_pairs(e, p["edges"], r, F.col("properties")["source"], p.get("most", 100)),
    "validation": lambda e, r, p: model.violations(e, r, p.get("strict", False)),
}


def refine(name: str, elements: DataFrame, relationships: DataFrame, params: dict | None = None) -> dict:
    """Result of a step: success, findings (a table, materialised), error.  An unknown name
    or a step that fails, while it is planned or while it runs, is a failed result, not an
    exception."""
    try:
        return {"step": name, "success": True, "findings": cut(REFINE[name](elements, relationships, params or {})), "error": None}
    except Exception as e:  # noqa: BLE001
        return {"step": name, "success": False, "findings": None, "error": f"{type(e).__name__}: {e}"}


def enrich(nodes: DataFrame, edges: DataFrame, steps: list[tuple[str, dict]], percentiles: bool = False) -> DataFrame:
    """Nodes with the columns of the named graph steps, null where a node has no edge."""
    found = graph.enriched(edges, [n for n, _ in steps], dict(steps), percentiles)
    return nodes.join(found.withColumnRenamed("node", "node_id"), "node_id", "left")


def patterns(table: DataFrame, step: str) -> tuple[list[str], list[str]]:
    """Included and excluded patterns of a step (JSON arrays of its active rows)."""
    rows = table.where((F.col("step_name") == step) & F.col("is_active")).select("pattern_type", F.explode(F.from_json("patterns", "array<string>")).alias("p")).distinct().collect()
    if not rows:
        raise ValueError(f"no patterns for {step}")
    return sorted(r["p"] for r in rows if r["pattern_type"] == "include"), sorted(r["p"] for r in rows if r["pattern_type"] == "exclude")


def generate(candidates: DataFrame, metrics: DataFrame, table: DataFrame, element_type: str, include: list[str], exclude: list[str], known: DataFrame, instruction: str, model_name: str, most: int = 30, size: int = 10) -> dict[str, DataFrame]:
    """One element type end to end: metrics, likely candidates, batches, prompts, stored
    responses, elements, and relationships to known elements.

    Prompts without a stored response come back as ``missing``; whoever runs the model
    adds their answers to the table and runs this again."""
    c = ranking.with_metrics(candidates.select("node_id", "name"), metrics)
    c = c.withColumn("likely", ranking.likely(F.col("name"), include, exclude))
    chosen = ranking.two_buckets(c, "likely", most)
    batches = ranking.batches(chosen, [F.col("pagerank").desc(), F.col("node_id").asc()], size)
    prompts = responses.batch_prompts(batches, instruction)
    answered = responses.answered(prompts, table, model_name)
    elements = responses.built_elements(responses.parsed(answered, "elements"), element_type)
    items = responses.parsed(answered, "relationships").select("source", "target", "relationship_type")
    every = known.select("identifier", "element_type").unionByName(elements.select("identifier", "element_type"))
    return {
        "elements": elements,
        "relationships": responses.valid_relationships(items, every, elements),
        "missing": responses.unanswered(prompts, table, model_name),
    }
