"""Queries of the operators in this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import handwritten, mixing, packing, pages, pieces, source_files, tokens, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
    return f


@query
def p1_found(t):
    return source_files.unparsable(t("file_nodes"), t("file_texts"))


@query
def p1_rates(t):
    return source_files.unparsable_rates(t("file_nodes"), t("file_texts"), t("extraction_config"))


def _records(t):
    return variants.canonical_records([(t("dependency_nodes"), variants.DEPENDENCIES), (t("technology_nodes"), variants.TECHNOLOGIES)])


@query
def p3_found(t):
    return variants.variant_copies(_records(t))


@query
def p3_collapsed(t):
    return variants.collapsed(_records(t))


@query
def p4_found(t):
    return source_files.found_functions(t("file_nodes"), t("file_texts"))


@query
def p4_pairs(t):
    return source_files.documented_functions(t("file_nodes"), t("file_texts"))


@query
def p4_candidates(t):
    return source_files.completed_candidates(t("candidates"), t("file_nodes"), t("file_texts"))


@query
def p5_found(t):
    large = pieces.oversized(t("file_nodes"), t("file_texts"), t("file_type_registry"))
    return pieces.cut_files(large)


@query
def p5_pieces(t):
    return pieces.pieces(t("file_nodes"), t("file_texts"), t("file_type_registry"))


@query
def p6_found(t):
    return handwritten.not_handwritten(t("file_nodes"), t("file_texts"))


@query
def p6_origins(t):
    return handwritten.file_origins(t("file_nodes"), t("file_texts"))


@query
def p6_report(t):
    return handwritten.origin_report(t("file_nodes"), t("file_texts"))


@query
def p7_packed(t):
    return packing.packed(tokens.document_sizes(t("documents")), t("pack_capacities"))


@query
def p7_report(t):
    return packing.packing_report(p7_packed(t), t("pack_capacities"))


@query
def p8_mix(t):
    return mixing.mixed(tokens.document_sizes(t("documents"), "source"), t("mix_targets"))[0]


@query
def p8_report(t):
    return mixing.mixed(tokens.document_sizes(t("documents"), "source"), t("mix_targets"))[1]


@query
def p9_found(t):
    return pages.stuffed_pages(t("documents"))


@query
def p9_kinds(t):
    kinds = pages.page_kinds(t("documents"))
    about = t("documents").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    return kinds.join(about, "doc_id").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum((F.col("share") > pages.NON_PROSE).cast("bigint")).alias("flagged")
    )


SQL["p5_found"] = r"""
WITH n AS (SELECT node_id, min(file_path) AS path FROM file_nodes WHERE node_id IS NOT NULL GROUP BY 1),
r AS (SELECT extension, min(chunk_max_tokens) AS most FROM file_type_registry WHERE chunk_max_tokens > 0 GROUP BY 1)
SELECT DISTINCT t.node_id FROM file_texts t JOIN n USING (node_id)
JOIN r ON r.extension = lower(regexp_extract(n.path, '\.[^.]*$'))
WHERE t.content IS NOT NULL AND length(t.content) // 4 > r.most
"""


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"


def _records_sql(table: str, name: str, category: str, ecosystem: str) -> str:
    """Key columns of a node table; the fields of its JSON are those it is known to have."""
    fields = []
    for f in ("description", "found_in.path", "found_in.line", "license"):
        value = _plain(f"properties_json->>'$.{f}'")
        fields += [f"json_type(properties_json, '$.{f}')", f"CASE WHEN json_type(properties_json, '$.{f}') = 'VARCHAR' THEN {value} ELSE CAST(properties_json->'$.{f}' AS VARCHAR) END"]
    return (
        f"SELECT '{table}' AS table_name, record_id, [repository_name, {_plain(name)}, {_plain(category)}, {ecosystem}, lower(trim(version)), {', '.join(fields)}, CAST(len(json_keys(properties_json)) AS VARCHAR)] AS k FROM {table}"
    )


_COPIES = (
    "WITH r AS (" + _records_sql("dependency_nodes", "dependency_name", "dependency_category", _plain("ecosystem")) + " UNION ALL " + _records_sql("technology_nodes", "tech_name", "tech_category", "NULL")
    + "), g AS (SELECT table_name, record_id, min(record_id) OVER (PARTITION BY table_name, k) AS kept_id FROM r)"
)
SQL["p3_found"] = _COPIES + " SELECT table_name, kept_id, record_id AS copy_id FROM g WHERE record_id <> kept_id"
SQL["p3_collapsed"] = _COPIES + " SELECT table_name, kept_id, count(*) AS copies FROM g GROUP BY 1, 2"
