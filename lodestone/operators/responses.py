"""Language-model steps over a table of responses: prompts, keys, parsing, validation.
No network: a response that the table does not have stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, coerced, dependency_id, iso_time, json_of, package_name, xml_name
from ..functions.values import ALLOWED, DEPENDENCY_KEYS, INTERFACES
from .model import metamodel

# The key under which each kind of response holds its array, and its fields.
CONTRACTS = {
    "elements": "array<struct<identifier:string,name:string,documentation:string,source:string,confidence:double>>",
    "relationships": "array<struct<source:string,target:string,relationship_type:string,name:string,confidence:double>>",
    "concepts": "array<struct<conceptName:string,conceptType:string,description:string,confidence:double>>",
    "technologies": "array<struct<techName:string,techCategory:string,version:string,confidence:double>>",
    "dependencies": "array<struct<dependencyName:string,dependencyCategory:string,version:string,ecosystem:string,confidence:double>>",
    "types": "array<struct<typeName:string,category:string,interfaceType:string,startLine:int,endLine:int>>",
    "methods": "array<struct<methodName:string,returnType:string,visibility:string,typeName:string>>",
    "tests": "array<struct<testName:string,testType:string,testedElement:string,framework:string>>",
}
def batch_prompts(candidates: DataFrame, instruction: str, example: str = "") -> DataFrame:
    """batch, prompt: instruction, example and the batch's candidates as JSON in the
    order of their ids.  A batch holds at most as many rows as it was made for."""
    item = F.to_json(F.struct("node_id", "name", F.round("pagerank", 4).alias("pagerank")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", item.alias("j")))), lambda x: x["j"]), ",")
    text = F.concat(F.lit(instruction + "\n"), F.lit(f"Example: {example}\n" if example else ""), F.lit("["), listed, F.lit("]"))
    return candidates.groupBy("batch").agg(text.alias("prompt"))


def _listed(fields: list[str], order: str) -> Column:
    """JSON list of a group's rows in the order of a column."""
    item = F.to_json(F.struct(*fields))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("j")))), lambda x: x["j"]), ","), F.lit("]"))


def relationship_prompts(elements: DataFrame, instruction: str) -> DataFrame:
    """batch, prompt: the elements of each batch (batch, identifier, name, element_type)
    and their identifiers, for relationships among them."""
    g = elements.groupBy("batch").agg(_listed(["identifier", "name", "element_type"], "identifier").alias("e"), F.to_json(F.array_sort(F.collect_list("identifier"))).alias("ids"))
    return g.select("batch", F.concat(F.lit(instruction + "\nElements: "), "e", F.lit("\nIdentifiers: "), "ids").alias("prompt"))


def element_type_prompts(sources: DataFrame, targets: DataFrame, rules: DataFrame, instruction: str) -> DataFrame:
    """element_type, batch, prompt: the source elements of a type and batch, the targets of
    the types that a rule of the source's type allows, and these rules.  Types without an
    applicable rule give no prompt.  Targets are those of one prompt's context (batch)."""
    mine = sources.groupBy("element_type", "batch").agg(_listed(["identifier", "name"], "identifier").alias("s"))
    there = targets.select("batch", F.col("element_type").alias("other_type")).distinct()
    allowed = rules.where("direction = 'outbound'").join(there, "other_type")
    text = allowed.groupBy("element_type", "batch").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "relationship_type", "other_type"))), "; ").alias("r"))
    near = targets.select("batch", "identifier", "name", F.col("element_type").alias("other_type")).join(allowed.select("element_type", "other_type", "batch").distinct(), ["other_type", "batch"])
    there_json = near.groupBy("element_type", "batch").agg(_listed(["identifier", "name", "other_type"], "identifier").alias("t"))
    j = mine.join(text, ["element_type", "batch"]).join(there_json, ["element_type", "batch"])
    return j.select("element_type", "batch", F.concat(F.lit(instruction + "\nSources: "), "s", F.lit("\nTargets: "), "t", F.lit("\nRules: "), "r").alias("prompt"))


def unified_prompts(new: DataFrame, existing: DataFrame, rules: DataFrame, instruction: str) -> DataFrame:
    """element_type, batch, prompt: relationships in both directions between the new
    elements of a batch and the existing ones of the types that applicable rules name.
    A rule is shown only if an element of its other type exists; a batch without such a
    rule has no prompt."""
    shown = applicable_rules(rules, existing)
    mine = new.groupBy("element_type", "batch").agg(_listed(["identifier", "name"], "identifier").alias("n"))
    text = shown.groupBy("element_type").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "direction", "relationship_type", "other_type"))), "; ").alias("r"))
    near = existing.select("identifier", "name", F.col("element_type").alias("other_type")).join(shown.select("element_type", "other_type").distinct(), "other_type")
    there = near.groupBy("element_type").agg(_listed(["identifier", "name", "other_type"], "identifier").alias("t"))
    j = mine.join(text, "element_type").join(there, "element_type")
    return j.select("element_type", "batch", F.concat(F.lit(instruction + "\nNew: "), "n", F.lit("\nExisting: "), "t", F.lit("\nRules: "), "r").alias("prompt"))


# Relationships that a derivation looks for: the type just made, whether it
# is their source (outbound) or target, the other type, and their kind.
RULES = (
    ("ApplicationService", "outbound", "BusinessObject", "Flow"), ("ApplicationService", "inbound", "TechnologyService", "Serving"),
    ("BusinessObject", "outbound", "BusinessObject", "Composition"), ("BusinessObject", "outbound", "BusinessObject", "Aggregation"),
    ("BusinessObject", "inbound", "BusinessProcess", "Access"), ("BusinessObject", "inbound", "ApplicationService", "Flow"),
    ("BusinessProcess", "outbound", "BusinessObject", "Access"),
    ("DataObject", "outbound", "TechnologyService", "Realization"), ("DataObject", "inbound", "TechnologyService", "Access"),
    ("DataObject", "inbound", "ApplicationService", "Flow"), ("DataObject", "inbound", "BusinessProcess", "Access"),
    ("TechnologyService", "outbound", "DataObject", "Access"), ("TechnologyService", "outbound", "ApplicationService", "Serving"),
    ("TechnologyService", "inbound", "DataObject", "Realization"),
)


def relationship_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "element_type string, direction string, other_type string, relationship_type string")


def applicable_rules(rules: DataFrame, existing: DataFrame) -> DataFrame:
    """The rules whose other type has an existing element."""
    return rules.join(existing.select(F.col("element_type").alias("other_type")).distinct(), "other_type", "left_semi")


def relevant_elements(rules: DataFrame, existing: DataFrame, element_type: str) -> DataFrame:
    """The existing elements of the other types in the rules of a type."""
    other = rules.where(F.col("element_type") == element_type).select(F.col("other_type").alias("element_type")).distinct()
    return existing.join(other, "element_type", "left_semi")


def answered(prompts: DataFrame, responses: DataFrame, model: str) -> DataFrame:
    """The prompts with ``cache_key`` and the response stored under it, null if none."""
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt"), F.lit(model)))
    one = responses.groupBy("cache_key").agg(F.max("content").alias("content"))
    return keyed.join(one, "cache_key", "left")


def unanswered(prompts: DataFrame, responses: DataFrame, model: str) -> DataFrame:
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt"), F.lit(model)))
    return keyed.join(responses.select("cache_key").distinct(), "cache_key", "left_anti")


def parsed(responses: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per array item under ``key`` (or ``schema.key``), all columns of the
    response kept.  Dependencies: a bare list is taken as it is; else ``dependencies``,
    if the response has that key, and only then the first further key that holds a
    list.  A response without such a list gives no rows."""
    text = json_of(F.col(content))
    is_list = lambda c: F.when(F.trim(c).startswith("["), c)
    if key == "dependencies":
        others = F.coalesce(*[is_list(F.get_json_object(text, f"$.{k}")) for k in DEPENDENCY_KEYS])
        has_key = F.array_contains(F.coalesce(F.json_object_keys(text), F.array()), "dependencies")
        listed = F.when(F.trim(text).startswith("["), text).when(has_key, is_list(F.get_json_object(text, "$.dependencies"))).otherwise(others)
    else:
        listed = F.coalesce(is_list(F.get_json_object(text, f"$.{key}")), is_list(F.get_json_object(text, f"$.schema.{key}")))
    return responses.withColumn("_item", F.explode(F.from_json(listed, CONTRACTS[key]))).select(*responses.columns, "_item.*")


def parse_error(key: str, content: Column) -> Column:
    """Why a response gives nothing: ``empty``, ``not json``, ``no list``; else null."""
    text = json_of(content)
    found = F.coalesce(F.get_json_object(text, f"$.{key}"), F.get_json_object(text, f"$.schema.{key}"))
    return F.when(content.isNull() | (F.trim(content) == ""), "empty").when(F.try_parse_json(text).isNull(), "not json").when(found.isNull() | ~F.trim(found).startswith("["), "no list")


def missing_fields(required: list[str]) -> Column:
    """Names of the required columns that are null, blank, 0 or false."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.col(c).cast("string").isin("", "0", "0.0", "false"), F.lit(c)) for c in required]))


def coerced_fields(rows: DataFrame) -> DataFrame:
    """Category columns with values that are not allowed replaced by their default; kinds
    of interface that are none become null."""
    for c, (allowed, default) in ALLOWED.items():
        if c in rows.columns:
            rows = rows.withColumn(c, coerced(F.col(c), list(allowed), default))
    if "interfaceType" in rows.columns:
        rows = rows.withColumn("interfaceType", F.when(F.col("interfaceType").isin(*INTERFACES), F.col("interfaceType")))
    return rows


#: Required fields of the items of each kind, the prefix of their nodes' ids and the edge
#: that joins the file to them.
NODES = {
    "concepts": (("conceptName", "conceptType"), "concept", "REFERENCES"),
    "technologies": (("techName", "techCategory"), "tech", "IMPLEMENTS"),
    "dependencies": (("dependencyName", "dependencyCategory"), "extdep", "USES"),
    "types": (("typeName", "category"), "typedef", "CONTAINS"),
    "methods": (("methodName",), "method", "CONTAINS"),
    "tests": (("testName", "testType"), "test", "TESTS"),
}


def extracted_nodes(responses: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejected items of stored responses (repository_name, file_path,
    content) of one kind: items with all required fields become nodes (node_id,
    repository_name, file_path, their fields with category values coerced), each once per
    id; every item gives an edge (source: the file, target, relationship_type); items
    that lack a field come back with the names of what is missing."""
    required, prefix, edge = NODES[key]
    items = parsed(responses.select("repository_name", "file_path", "content"), key).drop("content").withColumn("missing", missing_fields(list(required)))
    good = coerced_fields(items.where(F.size("missing") == 0).drop("missing"))
    name = F.col(required[0])
    here = F.col("file_path")
    if key == "dependencies":
        node = dependency_id(F.col("repository_name"), name)
    elif key in ("concepts", "technologies"):
        node = F.concat_ws("_", F.lit(prefix), "repository_name", F.translate(F.lower(name), " -", "__"))
    elif key == "tests":
        node = F.concat_ws("_", F.lit(prefix), "repository_name", F.translate(here, "/\\", "__"), F.translate(name, " -", "__"))
    elif key == "methods":
        node = F.concat_ws("_", F.lit(prefix), "repository_name", here, F.coalesce(F.nullif("typeName", F.lit("")), F.lit("module")), name)
    else:
        node = F.concat_ws("_", F.lit(prefix), "repository_name", here, name)
    named = good.withColumn("node_id", node)
    file_id = F.concat_ws("_", F.lit("file"), "repository_name", here)
    edges = named.select(file_id.alias("source"), F.col("node_id").alias("target"), F.lit(edge).alias("relationship_type")).distinct()
    every = F.struct(*[F.col(c) for c in named.columns])
    nodes = named.groupBy("node_id").agg(F.min_by(every, F.struct("file_path", name)).alias("r")).select("r.*")
    return nodes, edges, items.where(F.size("missing") > 0).select("repository_name", "file_path", "missing")


#: Fields of a node and the keys under which a response may hold them, the first that
#: is there, with the value that stands for none.
NODE_FIELDS = {
    "BusinessConcept": {"name": (("conceptName", "name"), ""), "category": (("conceptType", "concept_type", "type"), "other"), "description": (("description",), ""), "origin": (("originSource", "origin_source", "source_file", "file_path"), "")},
    "TypeDefinition": {"name": (("typeName", "name"), ""), "category": (("category", "type_category", "definition_type"), "class"), "description": (("description",), None), "origin": (("filePath", "file_path", "source_file"), "")},
    "Method": {"name": (("methodName", "name"), ""), "category": (("visibility",), "public"), "description": (("description",), None), "origin": (("filePath", "file_path", "source_file"), "")},
    "Technology": {"name": (("techName", "name"), ""), "category": (("techCategory", "tech_category", "category"), "service"), "description": (("description",), None), "origin": (("originSource", "origin_source", "source_file"), None)},
    "ExternalDependency": {"name": (("dependencyName", "name"), ""), "category": (("dependencyCategory", "dependency_category", "category"), "library"), "description": (("description",), None), "origin": (("origin_source", "source_file"), None)},
    "Test": {"name": (("name",), ""), "category": (("test_type",), "unit"), "description": (("description",), None), "origin": (("file_path", "source_file"), "")},
}


def node_of(label: str, properties: Column) -> Column:
    """Struct name, category, description, origin, confidence of a node of the label from
    its properties as JSON, in either style of naming; 0.8 is the confidence of none."""
    fields = []
    for field, (keys, default) in NODE_FIELDS[label].items():
        fields.append(F.coalesce(*[F.get_json_object(properties, f"$.{k}") for k in keys], F.lit(default).cast("string")).alias(field))
    return F.struct(*fields, F.coalesce(F.get_json_object(properties, "$.confidence").try_cast("double"), F.lit(0.8)).alias("confidence"))


def normalised_nodes(nodes: DataFrame, label: str, name: str = "name") -> DataFrame:
    """The nodes with their names in normal form: packages and technologies in the spelling
    known for them, concepts in the singular and joined; a dependency's id is made anew
    of its repository and normal name."""
    from ..functions.text import concept_name

    form = {"ExternalDependency": package_name, "Technology": package_name, "BusinessConcept": concept_name}.get(label)
    if form is None:
        return nodes
    out = nodes.withColumn(name, form(F.col(name)))
    return out.withColumn("node_id", dependency_id(F.col("repository_name"), F.col(name))) if label == "ExternalDependency" else out


def once_per_normal_name(nodes: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """The first node of each name in lower case with dashes and blanks as underscores."""
    from .ranking import first_of

    low = F.translate(F.lower(F.col(name)), "- ", "__")
    return first_of(nodes.withColumn("_low", low), ["_low"], order).drop("_low")


def built_elements(items: DataFrame, element_type: str, derived_at: Column | None = None) -> DataFrame:
    """Elements of parsed items that have identifier and name; confidence 0.5 if none;
    ``derived_at`` in their properties (now, unless given)."""
    some = items.where("identifier is not null and identifier <> '' and name is not null and name <> ''")
    return some.select(xml_name(F.col("identifier")).alias("identifier"), "name", F.lit(element_type).alias("element_type"), "documentation", F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("confidence"), F.coalesce("confidence", F.lit(0.5)).cast("string"), F.lit("derived_at"), iso_time(F.current_timestamp() if derived_at is None else derived_at)).alias("properties"))


def valid_relationships(items: DataFrame, elements: DataFrame, new: DataFrame) -> DataFrame:
    """Parsed relationships whose ends exist, of which one end at least is new, and whose
    triple of types the metamodel allows."""
    e = elements.select("identifier", "element_type").distinct()
    n = new.select("identifier").distinct().withColumn("_new", F.lit(True))
    j = (
        items.join(e.select(F.col("identifier").alias("source"), F.col("element_type").alias("source_type")), "source")
        .join(e.select(F.col("identifier").alias("target"), F.col("element_type").alias("target_type")), "target")
        .join(metamodel(items.sparkSession), ["relationship_type", "source_type", "target_type"])
        .join(n.select(F.col("identifier").alias("source"), F.col("_new").alias("_s")), "source", "left")
        .join(n.select(F.col("identifier").alias("target"), F.col("_new").alias("_t")), "target", "left")
    )
    return j.where("_s or _t").select(*items.columns)
