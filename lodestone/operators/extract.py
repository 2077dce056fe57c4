"""Dependencies, types and methods read from manifests and source files."""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import for_every_core
from .ranking import first_of


def method_of(path: Column, subtype: Column) -> Column:
    """How dependencies are read from a file: ``requirements_txt``, ``pyproject_toml``,
    ``package_json`` by its name in any case, ``python_ast``, else ``llm``."""
    n = F.regexp_extract(F.lower(path), r"([^/\\\\]*)$", 1)
    return (
        F.when((n == "requirements.txt") | n.endswith("-requirements.txt"), "requirements_txt").when(n == "pyproject.toml", "pyproject_toml").when(n == "package.json", "package_json")
        .when(F.lower(subtype) == "python", "python_ast").otherwise("llm")
    )


def _requirement(line: Column) -> tuple[Column, Column]:
    spec = F.trim(F.split(F.split(line, ";")[0], " @ ")[0])
    name = F.regexp_extract(spec, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    rest = F.trim(F.regexp_replace(spec, r"^[A-Za-z0-9][A-Za-z0-9._-]*(\[[^\]]*\])?", ""))
    number = F.regexp_extract(rest, r"(\d.*)$", 1)
    return name, F.when(rest == "", None).when(number != "", number).otherwise(rest)


def requirements(texts: DataFrame) -> DataFrame:
    """node_id, name, version of the lines of requirement files; blank lines, comments
    and options give none, the first of equal names (in any case) counts."""
    lines = texts.select("node_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.where("line <> '' and not startswith(line, '#') and not startswith(line, '-')")
    name, version = _requirement(F.col("line"))
    rows = lines.select("node_id", "pos", name.alias("name"), version.alias("version")).withColumn("low", F.lower("name")).where("name <> ''")
    return first_of(rows, ["node_id", "low"], [F.col("pos")]).select("node_id", "name", "version")


def pyproject(texts: DataFrame) -> DataFrame:
    """node_id, name, version from the first ``dependencies`` list of a pyproject file."""
    body = F.regexp_extract("content", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    items = texts.select("node_id", F.posexplode(F.regexp_extract_all(body, F.lit(r"""["']([^"']+)["']"""), 1)).alias("pos", "line"))
    name, version = _requirement(F.col("line"))
    rows = items.select("node_id", "pos", name.alias("name"), version.alias("version")).withColumn("low", F.lower("name")).where("name <> ''")
    return first_of(rows, ["node_id", "low"], [F.col("pos")]).select("node_id", "name", "version")


def package_json(texts: DataFrame) -> DataFrame:
    """node_id, name, version from dependencies, then devDependencies; a version that is
    no text is null, JSON that does not parse gives nothing."""
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>").alias("m")) for i, k in enumerate(("dependencies", "devDependencies"))])
    rows = texts.select("node_id", F.explode(kinds).alias("k")).select("node_id", "k.i", F.explode("k.m").alias("name", "version"))
    rows = rows.withColumn("version", F.when(F.col("version").rlike(r"^[\[{]"), None).otherwise(F.col("version")))
    return first_of(rows, ["node_id", "name"], [F.col("i")]).select("node_id", "name", "version")


_TREE = "node_id string, kind string, type_name string, name string, category string, parameters string, result string, is_static boolean, is_async boolean, start_line int, end_line int"


def _unparse(x) -> str | None:
    return None if x is None else ast.unparse(x)


def _tree(text: str) -> list[tuple]:
    """Imports, types and methods of a Python text (a byte order mark before it is
    dropped); none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []

    def function(owner: str, f) -> tuple:
        marks = {_unparse(d).split("(")[0].split(".")[-1] for d in f.decorator_list}
        args = [a.arg + (f": {_unparse(a.annotation)}" if a.annotation else "") for a in f.args.args]
        args += [f"*{f.args.vararg.arg}"] if f.args.vararg else []
        args += [f"**{f.args.kwarg.arg}"] if f.args.kwarg else []
        kind = "static" if "staticmethod" in marks else "class" if "classmethod" in marks else "property" if "property" in marks else "plain"
        return ("method", owner, f.name, kind, ", ".join(args), _unparse(f.returns), kind == "static", isinstance(f, ast.AsyncFunctionDef), f.lineno, f.end_lineno)

    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [("import", "", a.name.split(".")[0], "", None, None, False, False, node.lineno, node.end_lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            out.append(("import", "", node.module.split(".")[0], "", None, None, False, False, node.lineno, node.end_lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("type", "", node.name, "function", None, None, False, False, node.lineno, node.end_lineno))
            out.append(function("", node))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and _unparse(node.annotation).split(".")[-1] in ("TypeAlias", "TypeVar"):
            out.append(("type", "", node.target.id, "alias", None, None, False, False, node.lineno, node.end_lineno))
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append(("type", "", node.name, "class", None, None, False, False, node.lineno, node.end_lineno))
            out += [function(node.name, f) for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _TREE.split(", ")]
    for b in batches:
        yield pd.DataFrame([(n, *r) for n, t in zip(b["node_id"], b["content"]) for r in _tree(t)], columns=columns)


def python_records(texts: DataFrame) -> DataFrame:
    """Imports, types and methods of Python texts (node_id, content) by their syntax tree."""
    rows = for_every_core(texts.where("content is not null").select("node_id", "content"), "node_id")
    return rows.mapInPandas(_trees, _TREE)


def imported_packages(records: DataFrame) -> DataFrame:
    """node_id, name: packages a file imports at its top level, the standard library's
    left out, each once."""
    spark = records.sparkSession
    known = spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "name string")
    return records.where("kind = 'import'").select("node_id", "name").distinct().join(known, "name", "left_anti").select("node_id", "name")


def visibility(name: Column) -> Column:
    """``__x`` is protected, ``_x`` and ``__x__`` are private, the rest public."""
    return F.when(name.startswith("__") & ~name.endswith("__"), "protected").when(name.startswith("_"), "private").otherwise("public")


def method_nodes(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Method nodes (id and fields) and their CONTAINS edges from the file."""
    f = files.where("node_id is not null").groupBy("node_id").agg(F.min("repository_name").alias("repository_name"), F.min("file_path").alias("file_path"))
    owner = F.when(F.col("type_name") == "", "module").otherwise(F.col("type_name"))
    m = records.where("kind = 'method'").join(f, "node_id").withColumn("id", F.concat_ws("_", F.lit("method"), "repository_name", "file_path", owner, "name"))
    nodes = first_of(m, ["id"], [F.col("start_line")]).select("id", "name", "type_name", visibility(F.col("name")).alias("visibility"), "parameters", "result", "is_static", "is_async", "start_line", "end_line")
    return nodes, m.select(F.col("node_id").alias("source"), F.col("id").alias("target")).distinct()
