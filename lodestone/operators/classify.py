"""Classifying files by a registry of suffixes, names, patterns and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry_entries(registry: DataFrame) -> DataFrame:
    """entry_class (1 path, 2 full name, 3 wildcard, 4 suffix), pattern, file_type,
    subtype.  A suffix is a dot and at most four letters; other keys without wildcard
    are full names.  Rows without type are no entries."""
    key = F.lower(F.trim("extension"))
    kind = F.when(key.startswith("path:"), 1).when(key.contains("*"), 3).when(key.rlike(r"^\.[a-z]{1,4}$"), 4).otherwise(2)
    return registry.where("extension is not null and file_type is not null").select(kind.alias("entry_class"), F.regexp_replace(key, "^path:", "").alias("pattern"), "file_type", "subtype")


def classified(files: DataFrame, registry: DataFrame, path: str = "file_path") -> DataFrame:
    """The files with ``found_type``, ``found_subtype`` and ``reason`` (``no_extension``
    or ``unknown_extension`` where nothing fits).

    Path entries come first (all pieces between ** must occur in the lower-case path),
    then full names, then wildcards, then suffixes; within a class the entry of the
    least type and pattern.  Names and suffixes are equi-joins; the path and wildcard
    entries, of which a registry has a handful, are read once on the driver and tried
    in the same projection, so the files are never joined pairwise."""
    e = registry_entries(registry)
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    patterns = [r.asDict() for r in e.where("entry_class in (1, 3)").orderBy("entry_class", "file_type", "pattern").collect()]
    hit = F.lit(None).cast("struct<t:string,s:string>")
    wild = hit
    for p in reversed(patterns):
        value = F.struct(F.lit(p["file_type"]).alias("t"), F.lit(p["subtype"]).cast("string").alias("s"))
        if p["entry_class"] == 1:
            test = F.lit(True)
            for part in re.split(r"\*+", p["pattern"]):
                if part.strip("/"):
                    test = test & low.contains(part.strip("/"))
            hit = F.when(test, value).otherwise(hit)
        else:
            rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p["pattern"]) + "$"
            wild = F.when(name.rlike(rx), value).otherwise(wild)
    first = lambda n: e.where(F.col("entry_class") == n).groupBy("pattern").agg(F.min(F.struct("file_type", "subtype")).alias("x"))
    by_name = first(2).select(F.col("pattern").alias("_n"), F.struct(F.col("x.file_type").alias("t"), F.col("x.subtype").alias("s")).alias("_by_name"))
    by_suffix = first(4).select(F.col("pattern").alias("_s"), F.struct(F.col("x.file_type").alias("t"), F.col("x.subtype").alias("s")).alias("_by_suffix"))
    j = files.withColumn("_name", name).withColumn("_suffix", suffix).withColumn("_path_hit", hit).withColumn("_wild", wild)
    j = j.join(by_name, F.col("_name") == F.col("_n"), "left").join(by_suffix, F.col("_suffix") == F.col("_s"), "left")
    got = F.coalesce("_path_hit", "_by_name", "_wild", "_by_suffix")
    reason = F.when(got.isNotNull(), None).when(F.col("_suffix") == "", "no_extension").otherwise("unknown_extension")
    return (
        j.withColumn("_got", got).withColumn("found_type", F.col("_got.t")).withColumn("found_subtype", F.col("_got.s")).withColumn("reason", reason)
        .drop("_name", "_suffix", "_path_hit", "_wild", "_n", "_s", "_by_name", "_by_suffix", "_got")
    )


def unknown_suffixes(done: DataFrame, path: str = "file_path") -> DataFrame:
    """extension, files of what the registry does not know."""
    suffix = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1))
    return done.where("reason = 'unknown_extension'").groupBy(suffix.alias("extension")).agg(F.count(F.lit(1)).alias("files"))


_SOURCES = "struct<files:array<struct<type:string,subtype:string>>,nodes:array<string>>"


def input_sources(config: DataFrame) -> DataFrame:
    """The rows with ``file_specs`` and ``node_specs``; JSON that does not parse gives
    empty lists."""
    s = F.from_json("input_sources", _SOURCES)
    return config.withColumn("file_specs", F.coalesce(s["files"], F.array())).withColumn("node_specs", F.coalesce(s["nodes"], F.array()))


def matching_files(files: DataFrame, config: DataFrame) -> DataFrame:
    """node_type, node_id: the files that an active configuration row reads: its type is
    equal and its subtype equal or ``*``.  Rows without files match nothing."""
    specs = input_sources(config.where("is_active")).select("node_type", F.explode("file_specs").alias("f")).select("node_type", F.col("f.type").alias("file_type"), F.col("f.subtype").alias("_sub")).distinct()
    f = files.where("node_id is not null").select("node_id", "file_type", "subtype").distinct()
    return f.join(specs, "file_type").where((F.col("_sub") == "*") | (F.col("_sub") == F.col("subtype"))).select("node_type", "node_id").distinct()


def with_classification(files: DataFrame, classification: DataFrame) -> DataFrame:
    """Left join; unknown files have the type ``unknown`` and their suffix as subtype."""
    suffix = F.nullif(F.lower(F.regexp_extract("file_path", r"\.([^./]*)$", 1)), F.lit(""))
    j = files.join(classification.select("node_id", "found_type", "found_subtype"), "node_id", "left")
    return j.withColumn("found_subtype", F.when(F.col("found_type").isNull(), suffix).otherwise(F.col("found_subtype"))).withColumn("found_type", F.coalesce("found_type", F.lit("unknown")))


def test_targets(files: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """test_id, source_id, candidate_no: the source file of a test (all files are tried
    unless ``tests`` names them), by the first of the candidate paths that exists in the
    repository: in the same folder without ``test_`` before or ``_test`` behind the name
    or ``.spec``/``.test`` in it; for files below a folder of tests also the same path
    with src/ for tests/, the root, and the folder above."""
    f = files.where("node_id is not null and file_path is not null").groupBy("repository_name", "file_path").agg(F.min("node_id").alias("node_id"))
    own = f if tests is None else f.join(tests.select(F.col("node_id")).distinct(), "node_id", "left_semi")
    path = F.col("file_path")
    last = F.substring_index(path, "/", -1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")
    above = F.when(folder.contains("/"), F.regexp_replace(folder, r"/[^/]*$", "")).otherwise(".")
    ext = F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)
    name = last.substr(F.lit(1), F.length(last) - F.length(ext))
    plain = F.when(name.startswith("test_"), F.regexp_replace(name, "^test_", "")).otherwise(F.regexp_replace(name, "_test$", ""))
    below_tests = folder.contains("/tests/") | folder.contains("/test/") | folder.startswith("tests")
    at = lambda where, stem: F.concat(where, F.lit("/"), stem, ext)
    tries = F.array(
        F.when(name.startswith("test_"), at(folder, F.regexp_replace(name, "^test_", ""))),
        F.when(name.endswith("_test"), at(folder, F.regexp_replace(name, "_test$", ""))),
        F.when(name.contains(".spec") | name.contains(".test"), at(folder, F.regexp_replace(name, r"\.(spec|test)$", ""))),
        F.when(below_tests, at(F.regexp_replace(folder, "tests?/?", "src/"), plain)),
        F.when(below_tests, F.concat(plain, ext)),
        F.when(below_tests & (above != "."), at(above, plain)),
    )
    normal = F.transform(tries, lambda x: F.replace(F.regexp_replace(x, r"^[./]+", ""), F.lit("//"), F.lit("/")))
    each = own.select("repository_name", F.col("node_id").alias("test_id"), F.posexplode(normal).alias("candidate_no", "file_path")).where("file_path is not null")
    j = each.join(f.select("repository_name", "file_path", F.col("node_id").alias("source_id")), ["repository_name", "file_path"])
    return j.groupBy("test_id").agg(F.min_by("source_id", "candidate_no").alias("source_id"), F.min("candidate_no").alias("candidate_no"))


def directories(files: DataFrame) -> DataFrame:
    """repository_name, path, name, parent, files (directly in it), folders (directly in
    it), bytes (all below) of every folder of every file's path."""
    f = files.where("file_path is not null").groupBy("repository_name", "file_path").agg(F.max("size_bytes").alias("size"))
    parts = F.split("file_path", "/")
    up = f.withColumn("p", parts).where(F.size("p") > 1)
    each = up.select("repository_name", "size", F.size("p").alias("n"), "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("d"))
    rows = each.select("repository_name", F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("path"), "size", (F.col("d") == F.col("n") - 1).cast("int").alias("direct"))
    d = rows.groupBy("repository_name", "path").agg(F.sum("direct").alias("files"), F.sum("size").alias("bytes"))
    d = d.withColumn("parent", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")).withColumn("name", F.substring_index("path", "/", -1))
    inside = d.where("parent <> ''").groupBy("repository_name", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("folders"))
    return d.join(inside, ["repository_name", "path"], "left").fillna({"folders": 0})


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name) and CONTAINS edges (source, target) of repositories, their
    folders and files."""
    d = directories(files)
    repo = F.concat(F.lit("repo_"), F.col("repository_name"))
    folder = lambda c: F.concat_ws("_", F.lit("dir"), "repository_name", F.replace(c, F.lit("/"), F.lit("_")))
    f = files.where("file_path is not null").select("repository_name", "file_path").distinct()
    up = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", r"/[^/]*$", "")).otherwise("")
    file_id = F.concat_ws("_", F.lit("file"), "repository_name", "file_path")
    nodes = (
        f.select(repo.alias("id"), F.lit("Repository").alias("label"), F.col("repository_name").alias("name")).distinct()
        .unionByName(d.select(folder(F.col("path")).alias("id"), F.lit("Directory").alias("label"), "name"))
        .unionByName(f.select(file_id.alias("id"), F.lit("File").alias("label"), F.substring_index("file_path", "/", -1).alias("name")))
    )
    edges = d.select(F.when(F.col("parent") == "", repo).otherwise(folder(F.col("parent"))).alias("source"), folder(F.col("path")).alias("target")).unionByName(
        f.select(F.when(up == "", repo).otherwise(folder(up)).alias("source"), file_id.alias("target"))
    )
    return nodes, edges
