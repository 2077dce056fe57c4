"""A typed architecture model: its metamodel, validation and refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_name, similarity

# Element types by layer and aspect, and the aspects each relationship joins.
ELEMENTS = {
    "ApplicationComponent": ("Application", "structure"), "ApplicationInterface": ("Application", "structure"),
    "ApplicationService": ("Application", "behavior"), "DataObject": ("Application", "passive"),
    "BusinessActor": ("Business", "structure"), "BusinessProcess": ("Business", "behavior"), "BusinessFunction": ("Business", "behavior"),
    "BusinessEvent": ("Business", "behavior"), "BusinessObject": ("Business", "passive"),
    "Node": ("Technology", "structure"), "Device": ("Technology", "structure"), "SystemSoftware": ("Technology", "structure"),
    "TechnologyService": ("Technology", "behavior"),
}
RELATIONSHIPS = {
    "Composition": (("structure",), ("structure",)),
    "Aggregation": (("structure", "behavior"), ("structure", "behavior", "passive")),
    "Assignment": (("structure",), ("behavior",)),
    "Realization": (("structure", "behavior"), ("behavior", "passive")),
    "Serving": (("structure", "behavior"), ("structure", "behavior")),
    "Access": (("structure", "behavior"), ("passive",)),
    "Flow": (("behavior",), ("behavior",)),
}
#: Pairs of relationship types of which one between the same ends is redundant.
REDUNDANT = (("Serving", "Flow"), ("Access", "Flow"), ("Realization", "Serving"))
#: Relationship of the model that an edge of the code graph suggests.
PROPOSED = {"CONTAINS": "Composition", "CALLS": "Flow", "IMPORTS": "Serving", "USES": "Access"}


def element_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ELEMENTS.items()], "element_type string, layer string, aspect string")


def metamodel(spark: SparkSession) -> DataFrame:
    """relationship_type, source_type, target_type of every allowed triple."""
    rows = [
        (r, a, b) for r, (sources, targets) in RELATIONSHIPS.items() for a, (_, x) in ELEMENTS.items() if x in sources for b, (_, y) in ELEMENTS.items() if y in targets
    ]
    return spark.createDataFrame(rows, "relationship_type string, source_type string, target_type string")


def current(elements: DataFrame) -> DataFrame:
    """One row per identifier: the last delivered (ties: enabled ones first)."""
    every = F.struct(*[F.col(c) for c in elements.columns])
    return elements.where("identifier is not null").groupBy("identifier").agg(F.max_by(every, F.struct("loaded_at", "enabled", "name")).alias("r")).select("r.*")


def relationships_between(relationships: DataFrame, elements: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """The relationships whose two ends are elements, of a source, to a target, both or any."""
    ids = elements.select("identifier").distinct()
    some = relationships if source is None else relationships.where(F.col("source_id") == source)
    some = some if target is None else some.where(F.col("target_id") == target)
    return some.join(ids.select(F.col("identifier").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("identifier").alias("target_id")), "target_id", "left_semi")


def relationship_validity(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """identifier, valid, reason of each relationship whose ends exist.  The reason is the
    first of: ``unknown source type``, ``unknown target type``, ``unknown relationship
    type``, ``source not allowed``, ``target not allowed``; else null.  The metamodel has
    a few hundred rows at most."""
    e = elements.select("identifier", "element_type")
    s = e.select(F.col("identifier").alias("source_id"), F.col("element_type").alias("source_type"))
    t = e.select(F.col("identifier").alias("target_id"), F.col("element_type").alias("target_type"))
    aspect = lambda c: F.create_map(*[F.lit(x) for k, (_, a) in ELEMENTS.items() for x in (k, a)])[c]
    allows = lambda side: F.create_map(*[x for k, v in RELATIONSHIPS.items() for x in (F.lit(k), F.array(*map(F.lit, v[side])))])[F.col("relationship_type")]
    j = relationships.join(s, "source_id").join(t, "target_id")
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    reason = (
        F.when(~known("source_type", ELEMENTS), "unknown source type").when(~known("target_type", ELEMENTS), "unknown target type")
        .when(~known("relationship_type", RELATIONSHIPS), "unknown relationship type")
        .when(~F.array_contains(allows(0), aspect(F.col("source_type"))), "source not allowed").when(~F.array_contains(allows(1), aspect(F.col("target_type"))), "target not allowed")
    )
    return j.select("identifier", reason.isNull().alias("valid"), reason.alias("reason"))


def relationships_from(spark: SparkSession, element_type: str) -> DataFrame:
    """relationship_type, target_type that may begin at an element of the type."""
    return metamodel(spark).where(F.col("source_type") == element_type).select("relationship_type", "target_type")


def flow_serving(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row, relationships: how many Flow and Serving relationships join enabled elements."""
    some = relationships.where(F.col("relationship_type").isin("Flow", "Serving"))
    return relationships_between(some, elements.where("enabled")).agg(F.count(F.lit(1)).alias("relationships"))


def without_relationships(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """Enabled elements that no relationship touches, whatever its other end."""
    ends = relationships.select(F.explode(F.array("source_id", "target_id")).alias("identifier")).where("identifier is not null").distinct()
    return elements.where("enabled").join(ends, "identifier", "left_anti")


def without_layer(elements: DataFrame, relationships: DataFrame, layer: str, other: str) -> DataFrame:
    """Enabled elements of a layer that no relationship, in either direction, joins to
    an element of the other layer (enabled or not)."""
    types = element_types(elements.sparkSession)
    typed = elements.join(types, "element_type")
    far = typed.where(F.col("layer") == other).select(F.col("identifier").alias("far"))
    r = relationships.where("source_id is not null and target_id is not null")
    both = r.select(F.col("source_id").alias("identifier"), F.col("target_id").alias("far")).unionByName(r.select(F.col("target_id").alias("identifier"), F.col("source_id").alias("far")))
    joined = both.join(far, "far", "left_semi").select("identifier").distinct()
    return typed.where((F.col("layer") == layer) & F.col("enabled")).join(joined, "identifier", "left_anti")


def layer_gaps(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """identifier, issue for business without application, application without technology
    and technology without application."""
    checks = (("Business", "Application"), ("Application", "Technology"), ("Technology", "Application"))
    parts = [without_layer(elements, relationships, a, b).select("identifier", F.lit(f"{a} without {b}".lower()).alias("issue")) for a, b in checks]
    return reduce(DataFrame.unionByName, parts)


def duplicate_relationships(relationships: DataFrame) -> DataFrame:
    """identifier, kept_id of relationships that repeat another's source, target and
    type: the least identifier stays.  One aggregated row per triple is joined back."""
    key = ["source_id", "target_id", "relationship_type"]
    r = relationships.where("source_id is not null and target_id is not null").select("identifier", *key).distinct()
    kept = r.groupBy(*key).agg(F.min("identifier").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return r.join(kept, key).where("identifier <> kept_id").select("identifier", "kept_id")


def redundant_relationships(relationships: DataFrame) -> DataFrame:
    """source_id, target_id, pair of ends joined by two types of which one is enough."""
    g = relationships.where("source_id is not null and target_id is not null").groupBy("source_id", "target_id").agg(F.collect_set("relationship_type").alias("types")).where(F.size("types") > 1)
    found = F.array_compact(F.array(*[F.when(F.array_contains("types", a) & F.array_contains("types", b), F.lit(f"{a}+{b}")) for a, b in REDUNDANT]))
    return g.select("source_id", "target_id", F.explode(found).alias("pair"))


def similar_elements(elements: DataFrame, fuzzy: float = 0.85, by: tuple[str, ...] = ("repository_name", "element_type"), synonyms: dict[str, str] | None = None, lemmas: bool = False) -> DataFrame:
    """by, name, other, similarity of unequal normal names (see text.normal_name) of the
    enabled elements in one group, whose similarity is at least ``fuzzy``; the shorter
    name first, at equal length the lesser.  Elements with one normal name but unequal
    names have that name twice in a row, with similarity 1.

    Names are compared once each: distinct names are paired by blocks of equal length
    and equal pieces, which loses no pair: a pair within d edits shares one of the d + 1
    pieces of the shorter name, at its place give or take as many characters as the
    edits before and after it can shift it by."""
    by = list(by)
    raw = elements.where("enabled and name is not null and name <> ''").select(*by, normal_name(F.col("name"), synonyms, lemmas).alias("normal"), "name").distinct()
    names = raw.groupBy(*by, F.col("normal").alias("name")).agg(F.count(F.lit(1)).alias("spellings")).where("name <> ''").withColumn("n", F.length("name"))
    same = names.where("spellings > 1").select(*by, "name", F.col("name").alias("other"), F.lit(1.0).alias("similarity"))
    # edits allowed for the longer length, and pieces of the shorter one
    longest = F.floor(F.col("n") / fuzzy + 1e-9).cast("int")
    edits = F.floor(longest * (1 - fuzzy) + 1e-9).cast("int")
    a = names.drop("spellings").withColumn("edits", edits).withColumn("pieces", F.col("edits") + 1)
    a = a.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("k"))
    begin = F.floor(F.col("k") * F.col("n") / F.col("pieces")).cast("int")
    a = a.withColumn("begin", begin).withColumn("piece", F.expr("substring(name, begin + 1, cast(floor((k + 1) * n / pieces) as int) - begin)")).where(F.length("piece") > 0)
    b = names.select(*by, F.col("name").alias("other"), F.col("n").alias("m"))
    # each longer name offers the pieces that a name of s characters could hold there: the
    # k-th piece has k edits before it at most if it is the first that is whole, and its
    # place in the longer name differs by what is left of the difference in length
    b = b.withColumn("s", F.explode(F.sequence(F.ceil(F.col("m") * fuzzy - 1e-9).cast("int"), F.col("m"))))
    b = b.withColumn("e", F.floor(F.floor(F.col("s") / fuzzy + 1e-9) * (1 - fuzzy) + 1e-9).cast("int"))
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("e"))))
    b = b.withColumn("from", F.floor(F.col("k") * F.col("s") / (F.col("e") + 1)).cast("int")).withColumn("len", F.floor((F.col("k") + 1) * F.col("s") / (F.col("e") + 1)).cast("int") - F.col("from"))
    longer = F.col("m") - F.col("s")
    left, right = F.floor((F.col("e") - longer) / 2), F.floor((F.col("e") + longer) / 2)
    b = b.where("len > 0 and m - s <= e").withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("from") - left).cast("int"), (F.col("from") + right).cast("int"))))
    b = b.withColumn("piece", F.expr("substring(other, at + 1, len)")).select(*by, F.col("s").alias("n"), "k", "piece", "other").distinct()
    pairs = a.select(*by, "name", "n", "k", "piece").join(b, [*by, "n", "k", "piece"])
    both = pairs.where((F.length("name") < F.length("other")) | ((F.length("name") == F.length("other")) & (F.col("name") < F.col("other")))).select(*by, "name", "other").distinct()
    return both.withColumn("similarity", similarity(F.col("name"), F.col("other"))).where(F.col("similarity") >= fuzzy).unionByName(same)


def equal_elements(elements: DataFrame) -> DataFrame:
    """identifier, kept_id of enabled elements that repeat a name within type and
    repository: the one with the highest ``source_pagerank`` among its properties (0 if
    there is none) stays, of these the one with the longest documentation, then the least
    identifier."""
    key = ["repository_name", "element_type", "name"]
    e = elements.where("enabled and name is not null")
    rank = F.coalesce(F.col("properties")["source_pagerank"].try_cast("double"), F.lit(0.0)) if "properties" in e.columns else F.lit(0.0)
    e = e.select(*key, "identifier", F.struct((-rank).alias("rank"), (-F.coalesce(F.length("documentation"), F.lit(0))).alias("length"), F.col("identifier").alias("id")).alias("_by"))
    top = e.groupBy(*key).agg(F.min("_by")["id"].alias("kept_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return e.join(top, key).where("identifier <> kept_id").select("identifier", "kept_id")


def disabled(elements: DataFrame, duplicates: DataFrame, why: str = "duplicate") -> DataFrame:
    """The elements with the duplicates disabled for a reason that names what is kept."""
    d = duplicates.groupBy("identifier").agg(F.min("kept_id").alias("_kept"))
    j = elements.join(d, "identifier", "left")
    reason = F.when(F.col("_kept").isNotNull() & F.col("enabled"), F.concat(F.lit("duplicate_of:"), "_kept", F.lit(f":{why}"))).otherwise(F.col("disabled_reason"))
    return j.withColumn("disabled_reason", reason).withColumn("enabled", F.col("enabled") & F.col("_kept").isNull()).drop("_kept")


def orphan_actions(elements: DataFrame, relationships: DataFrame, importance: str | None = None, least: float = 0.0, disable: bool = False) -> DataFrame:
    """identifier, action of the elements without relationships: ``disable`` where asked
    for and their importance is below ``least``, else ``flag``."""
    o = without_relationships(elements, relationships)
    low = (F.coalesce(F.col(importance).cast("double"), F.lit(0.0)) < least) if importance else F.lit(least > 0)
    return o.select("identifier", F.when(F.lit(disable) & low, "disable").otherwise("flag").alias("action"))


def proposed_relationships(orphans: DataFrame, edges: DataFrame, source_of: DataFrame, most: int = 5) -> DataFrame:
    """source_id, target_id, relationship_type proposed for orphans from the edges of
    the code graph between the nodes the elements came from, ``most`` per orphan by
    target.  source_of: identifier, node_id."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in PROPOSED.items() for x in kv])[F.col("relationship_type")], F.lit("Association"))
    a = source_of.join(orphans.select("identifier"), "identifier", "left_semi").select(F.col("identifier").alias("source"), F.col("node_id").alias("source_id"))
    b = source_of.select(F.col("identifier").alias("target"), F.col("node_id").alias("target_id"))
    j = edges.select("source_id", "target_id", "relationship_type").distinct().join(a, "source_id").join(b, "target_id")
    r = F.row_number().over(Window.partitionBy("source").orderBy("target", "relationship_type"))
    return j.withColumn("r", r).where(F.col("r") <= most).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), kind.alias("relationship_type"))


def violations(elements: DataFrame, relationships: DataFrame, strict: bool = False) -> DataFrame:
    """subject, rule of everything that is wrong: missing fields, unknown types, repeated
    identifiers, ends that do not exist; with ``strict`` also identifiers without the
    ``id-`` prefix, self loops and elements without relationships."""
    e, r = elements, relationships
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    ids = e.select("identifier").distinct()
    rule = lambda df, key, name: df.select(F.col(key).cast("string").alias("subject"), F.lit(name).alias("rule"))
    parts = [
        rule(e.where(blank("identifier")), "name", "element without identifier"),
        rule(e.where(blank("name")), "identifier", "element without name"),
        rule(e.where(~F.coalesce(F.col("element_type").isin(*ELEMENTS), F.lit(False))), "identifier", "unknown element type"),
        rule(r.where(~F.coalesce(F.col("relationship_type").isin(*RELATIONSHIPS), F.lit(False))), "identifier", "unknown relationship type"),
        rule(e.groupBy("identifier").count().where("count > 1"), "identifier", "repeated identifier"),
        rule(r.join(ids.select(F.col("identifier").alias("source_id")), "source_id", "left_anti"), "identifier", "source does not exist"),
        rule(r.join(ids.select(F.col("identifier").alias("target_id")), "target_id", "left_anti"), "identifier", "target does not exist"),
    ]
    if strict:
        parts += [
            rule(e.where(~F.col("identifier").startswith("id-")), "identifier", "identifier without prefix"),
            rule(r.where("source_id = target_id"), "identifier", "self loop"),
            rule(without_relationships(e, r), "identifier", "element without relationships"),
        ]
    return reduce(DataFrame.unionByName, parts)


def exported(elements: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled elements, and the relationships both of whose ends are enabled."""
    e = elements.where("enabled")
    ids = e.select("identifier").distinct()
    r = relationships.join(ids.select(F.col("identifier").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("identifier").alias("target_id")), "target_id", "left_semi")
    return e, r


def contained_pairs(elements: DataFrame, edges: DataFrame, relationships: DataFrame, source: Column, most: int = 100) -> DataFrame:
    """parent, child elements whose source nodes contain each other in the code graph
    while the model has no relationship between them; the first ``most`` by ids."""
    own = elements.where("enabled").select("identifier", source.alias("node_id")).where("node_id is not null")
    c = edges.where("relationship_type = 'CONTAINS'").select("source_id", "target_id").distinct()
    j = c.join(own.select(F.col("identifier").alias("parent"), F.col("node_id").alias("source_id")), "source_id").join(own.select(F.col("identifier").alias("child"), F.col("node_id").alias("target_id")), "target_id")
    have = relationships.select(F.col("source_id").alias("parent"), F.col("target_id").alias("child")).distinct()
    return j.select("parent", "child").distinct().join(have, ["parent", "child"], "left_anti").orderBy("parent", "child").limit(most)
