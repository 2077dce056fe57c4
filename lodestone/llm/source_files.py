"""Source files that do not parse, and functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, width

#: Suffix of a path and the language of its grammar.  Fixed values.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go"}


def language_of(path: Column) -> Column:
    """Language by the path's suffix in any case, null for other suffixes."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def with_texts(files: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """One row per node of a source language whose text could be read.

    ``files`` may hold a node several times (delivered again, deleted and back): its
    least path counts, and the least value of each further column.  Both sides are
    spread by node, so that the join needs no further exchange and the parsing that
    follows has work for every core.
    """
    n = width(files.sparkSession, 3, texts)
    nodes = (
        files.where(F.col("node_id").isNotNull() & language_of(F.col("file_path")).isNotNull())
        .groupBy("node_id")
        .agg(F.min("file_path").alias("file_path"), *[F.min(c).alias(c) for c in columns])
        .withColumn("language", language_of(F.col("file_path")))
        .repartition(n, "node_id")
    )
    read = texts.where("content is not null and node_id is not null").select("node_id", "content").repartition(n, "node_id")
    return nodes.join(read, "node_id")


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The columns of the batches with the verdict in place of the text."""
    from .languages import LEXERS, parses

    for b in batches:
        ok = [parses(lang, LEXERS[lang](text)) for lang, text in zip(b["language"], b["content"])]
        yield b.drop(columns="content").assign(parses=ok)


def parse_verdicts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """node_id, parses: whether a dialect of the suffix's language derives the text.

    Each text runs through the generalised LL recogniser of its language (all dialects
    over one stack).  Nulls: a node without id, path or text gives no row.  An empty
    text parses where the grammar derives nothing (Python, JavaScript, TypeScript,
    Java) and, as an empty file is no error, in Go as well.  A text of any length is
    parsed whole; extra columns are ignored.
    """
    return with_texts(files, texts).select("node_id", "language", "content").mapInPandas(_verdicts, "node_id string, language string, parses boolean").drop("language")


def unparsable(files: DataFrame, texts: DataFrame) -> DataFrame:
    """node_id of the files that no dialect of their language derives."""
    return parse_verdicts(files, texts).where("not parses").select("node_id")


def unparsable_rates(files: DataFrame, texts: DataFrame, config: DataFrame) -> DataFrame:
    """Shares of unparsable files: one row per repository, per language, and per
    extraction method of the active configuration rows whose input sources name the
    file's type and subtype (``*`` stands for any).  A file read by several rows of a
    method counts once for it; a null repository is its own group.

    dimension, key, files, broken, share
    """
    nodes = with_texts(files, texts, "repository_name", "file_type", "subtype").select("language", "repository_name", "file_type", "subtype", "content")
    rows = nodes.mapInPandas(_verdicts, "language string, repository_name string, file_type string, subtype string, parses boolean")
    spec = "struct<files:array<struct<type:string,subtype:string>>>"
    specs = (
        config.where("is_active")
        .select("extraction_method", F.explode(F.from_json("input_sources", spec)["files"]).alias("f"))
        .select("extraction_method", F.col("f.type").alias("file_type"), F.col("f.subtype").alias("spec"))
        .distinct()
    )
    # at most a few rows per type; aggregated to one list per type before the join
    per_type = specs.groupBy("file_type").agg(F.collect_set(F.struct("extraction_method", "spec")).alias("specs"))
    methods = F.array_distinct(
        F.transform(
            F.filter(F.coalesce("specs", F.array()), lambda s: (s["spec"] == "*") | (s["spec"] == F.coalesce(F.col("subtype"), F.col("language")))),
            lambda s: s["extraction_method"],
        )
    )
    keyed = rows.join(per_type, "file_type", "left").select(
        "parses",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("repository").alias("dimension"), F.col("repository_name").alias("key")),
                    F.struct(F.lit("language").alias("dimension"), F.col("language").alias("key")),
                ),
                F.transform(methods, lambda m: F.struct(F.lit("extraction_method").alias("dimension"), m.alias("key"))),
            )
        ).alias("k"),
    )
    return keyed.groupBy(F.col("k.dimension").alias("dimension"), F.col("k.key").alias("key")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.when(F.col("parses"), 0).otherwise(1)).alias("broken"),
        F.avg(F.when(F.col("parses"), 0.0).otherwise(1.0)).alias("share"),
    )


# ---------------------------------------------------------------- functions and their documentation
_SYMBOL = "node_id string, type_name string, method_name string, signature string, doc string, words int, has_body boolean, listed boolean, supers array<string>, begin int, finish int"


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .languages import LEXERS, parses
    from .symbols import SYMBOLS, useful_words

    columns = [c.split()[0] for c in _SYMBOL.split(", ")]
    for b in batches:
        out = []
        for node, lang, text in zip(b["node_id"], b["language"], b["content"]):
            lexed = LEXERS[lang](text)
            if not parses(lang, lexed):
                continue
            for s in SYMBOLS[lang](lexed):
                words = 0 if s.doc is None else useful_words(s.doc, s.type_name, s.method_name)
                out.append((node, s.type_name, s.method_name, s.signature, s.doc, words, s.has_body, s.listed, list(s.supers), s.start, s.end))
        yield pd.DataFrame(out, columns=columns)


#: Least number of words a description must keep.
MIN_WORDS = 3


def symbol_table(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Every function and method of the files that parse, qualified by repository,
    language and type: node_id, repository_name, file_path, language, family (JavaScript
    and TypeScript are one), type_name, method_name, signature (normalised parameter
    types), doc, words, has_body, listed, supers, begin, finish (where it stands in the
    text after ``normalise``).  Each file is parsed once: the table is checkpointed."""
    found = with_texts(files, texts).select("node_id", "language", "content").mapInPandas(_symbols, _SYMBOL)
    names = files.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("repository_name").alias("repository_name"), F.min("file_path").alias("file_path"))
    named = found.join(names, "node_id").withColumn("language", language_of(F.col("file_path")))
    family = F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language"))
    return cut(named.withColumn("family", family))


_TYPE = ["repository_name", "family", "type_name"]


def ancestors(table: DataFrame) -> DataFrame:
    """repository_name, family, type_name, ancestor, steps: the types that a type extends
    or implements, directly (1 step) or through others, by name within the repository;
    the least number of steps counts."""
    edges = cut(table.where("type_name <> '' and repository_name is not null").select(*_TYPE, F.explode("supers").alias("ancestor")).where("ancestor <> type_name").distinct())
    seen = edges.withColumn("steps", F.lit(1))
    front, steps = edges, 1
    known = edges.select("repository_name", "family", F.col("type_name").alias("ancestor"), F.col("ancestor").alias("further"))
    while not (front := cut(front.join(known, ["repository_name", "family", "ancestor"]).select(*_TYPE, F.col("further").alias("ancestor")).where("ancestor <> type_name").distinct().join(seen, [*_TYPE, "ancestor"], "left_anti"))).isEmpty():
        steps += 1
        seen = cut(seen.unionByName(front.withColumn("steps", F.lit(steps))))
    return seen


def _words_left(doc: Column) -> Column:
    """Like ``symbols.useful_words``, in the JVM."""
    lines = F.filter(F.split(doc, "\n"), lambda x: ~F.trim(x).rlike(r"^[@:]"))
    words = F.regexp_extract_all(F.lower(F.array_join(lines, "\n")), F.lit(r"(\p{L}+)"), 1)
    parts = lambda c: F.regexp_extract_all(c, F.lit(r"([^\P{L}\p{Lu}]+|\p{Lu}+(?![^\P{L}\p{Lu}])|\p{Lu}[^\P{L}\p{Lu}]*)"), 1)
    names = F.transform(F.concat(parts(F.col("type_name")), parts(F.col("method_name"))), F.lower)
    return F.size(F.filter(words, lambda w: ~F.array_contains(names, w)))


def described(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of a symbol table with ``description``, ``kept_words`` and ``doc_source``.

    Documented declarations (methods of interfaces, abstract methods, overload
    signatures, stubs) are joined with the definitions that stand elsewhere under the
    same qualified name, or in a type that extends or implements the declaring one: the
    declaration with the same normalised parameter types, else one of any overload; of
    several, that of the nearest type, then the least text.  Only then are words
    counted: a definition keeps its own documentation if min_words are left of it
    (``own``), else it takes the declaration's (``declaration``), else its own, such as
    it is.  Declarations reach the join reduced to one per key, so a name that a third
    of all files share adds one row to it.  A null repository has no other files.
    """
    key = ["repository_name", "family", "type_name", "method_name"]
    declared = table.where("not has_body and doc is not null and repository_name is not null")
    same = declared.groupBy(*key, "signature").agg(F.min("doc").alias("same"))
    other = declared.groupBy(*key).agg(F.min("doc").alias("other"))
    up = ancestors(table).select("repository_name", "family", "type_name", "ancestor", "steps")
    asked = table.where(f"has_body and words < {int(min_words)} and repository_name is not null").select(*key, "signature").distinct()
    places = asked.withColumn("place", F.col("type_name")).withColumn("steps", F.lit(0)).unionByName(asked.join(up, _TYPE).select(*key, "signature", F.col("ancestor").alias("place"), "steps"))
    at = [F.col("repository_name"), F.col("family"), F.col("place").alias("type_name"), F.col("method_name")]
    looked = places.select(*at, "signature", F.col("type_name").alias("owner"), "steps").join(other, key).join(same, [*key, "signature"], "left")
    best = F.min(F.struct(F.col("same").isNull().alias("inexact"), "steps", F.coalesce("same", "other").alias("declared")))
    taken = looked.groupBy("repository_name", "family", F.col("owner").alias("type_name"), "method_name", "signature").agg(best["declared"].alias("declared"))
    joined = table.join(taken, [*key, "signature"], "left")
    from_there = F.col("has_body") & (F.col("words") < min_words) & F.col("declared").isNotNull()
    words = F.when(from_there, _words_left(F.col("declared"))).otherwise(F.col("words"))
    return cut(
        joined.withColumn("doc_source", F.when(from_there, "declaration").when(F.col("doc").isNotNull(), "own"))
        .withColumn("description", F.when(from_there, F.col("declared")).otherwise(F.col("doc")))
        .withColumn("kept_words", words)
        .drop("declared", "doc", "words")
    )


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .languages import normalise

    for b in batches:
        out = []
        for node, text, spans in zip(b["node_id"], b["content"], b["spans"]):
            text = normalise(text)
            out += [(node, int(s["begin"]), int(s["finish"]), text[s["begin"] : s["finish"]]) for s in spans]
        yield pd.DataFrame(out, columns=["node_id", "begin", "finish", "code"])


def documented_functions(files: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Code and description of each function with documentation worth keeping: node_id,
    repository_name, language, file_path, type_name, method_name, signature, code,
    description, doc_source (see ``described``).  Functions whose description keeps fewer
    than ``min_words`` words are dropped.  Equal rows of one file (a function declared
    twice) are kept once.  The code is cut out of the text by offset, once the rows are
    known.  Null texts give nothing."""
    rows = described(symbol_table(files, texts), min_words).where(f"listed and kept_words >= {int(min_words)}")
    spans = rows.groupBy("node_id").agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))
    read = texts.where("content is not null").select("node_id", "content")
    code = read.join(spans, "node_id").mapInPandas(_sliced, "node_id string, begin int, finish int, code string")
    kept = ["node_id", "repository_name", "language", "file_path", "type_name", "method_name", "signature", "code", "description", "doc_source"]
    return rows.join(code, ["node_id", "begin", "finish"]).select(*kept).distinct()


def found_functions(files: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """node_id, type_name, method_name of the functions whose documentation stands with
    themselves: the rows of ``described`` that needed no declaration."""
    rows = described(symbol_table(files, texts), min_words)
    return rows.where(f"listed and doc_source = 'own' and kept_words >= {int(min_words)}").select("node_id", "type_name", "method_name").distinct()


def completed_candidates(candidates: DataFrame, files: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Candidates (one row per node) with the docstring that their source has, be it at
    the function or at its declaration.

    A candidate is found by its id, which is built of repository, path, type (``module``
    outside types) and method.  ``status``: ``kept`` (the source says the same),
    ``completed`` (it had none), ``corrected`` (it differed), ``unsupported`` (the
    source has the function without documentation worth keeping, the docstring goes),
    ``unknown`` (no such function in a file that parses; the docstring stays).
    """
    s = described(symbol_table(files, texts), min_words).where("listed")
    keyed = s.select(
        F.concat_ws("_", F.lit("method"), "repository_name", "file_path", F.when(F.col("type_name") == "", "module").otherwise(F.col("type_name")), "method_name").alias("node_id"),
        F.when(F.col("kept_words") >= min_words, F.trim("description")).alias("doc"),
    )
    source = keyed.groupBy("node_id").agg(F.max("doc").alias("source_doc"), F.lit(True).alias("seen"))
    one = candidates.groupBy("node_id").agg(
        F.max(F.col("properties")["methodName"]).alias("method_name"),
        F.max(F.col("properties")["typeName"]).alias("type_name"),
        F.max(F.trim(F.col("properties")["docstring"])).alias("old"),
    )
    squash = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    j = one.join(source, "node_id", "left")
    status = (
        F.when(F.col("seen").isNull(), "unknown")
        .when(F.col("source_doc").isNull(), "unsupported")
        .when(F.col("old").isNull(), "completed")
        .when(squash(F.col("old")) == squash(F.col("source_doc")), "kept")
        .otherwise("corrected")
    )
    return j.select(
        "node_id", "type_name", "method_name",
        F.when(F.col("seen").isNull(), F.col("old")).otherwise(F.col("source_doc")).alias("docstring"),
        status.alias("status"),
    )
