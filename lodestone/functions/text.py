"""Scalar functions on names, paths, JSON and texts, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import IRREGULAR, NOUN_ENDINGS, PACKAGE_ENDINGS, PACKAGES, SYNONYMS, UNCOUNTABLE, VERB_ENDINGS


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def stripped(x: Column) -> Column:
    """Without white space of any kind around it (trim takes blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def slug(x: Column) -> Column:
    """Lower case, blanks and dashes as underscores, else letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(x), " -", "__"), r"[^\p{L}\p{N}_]", "")


def node_id(prefix: str, repository: Column, x: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), repository, slug(x))


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lower(kind), F.lit("_"), source, F.lit("_to_"), target)


def event_edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("_", kind, source, target)


def graph_edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("_", source, kind, target)


def without_chunk_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\s*\(lines \d+-\d+\)$", "")


def normal_path(path: Column, repository: Column) -> Column:
    """Forward slashes, no leading ./ or /, below the repository's name."""
    p = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"/{2,}", "/"), r"^(\./)+|^/+", "")
    p = F.when(p == ".", "").otherwise(p)
    inner = F.when(p == repository, "").when(p.startswith(F.concat(repository, F.lit("/"))), p.substr(F.length(repository) + 2, F.length(p))).otherwise(p)
    return F.when(inner == "", repository).otherwise(F.concat(repository, F.lit("/"), inner))


#: Prefixes of node ids.  Fixed values.
ID_PREFIXES = ("repo", "dir", "module", "file", "concept", "tech", "typedef", "method", "test", "service", "extdep")


def repository_of(node: Column) -> Column:
    """The second part of a node id with a known prefix; all but the first of repo_ ids.
    A repository whose name holds an underscore is cut: carry its column instead."""
    parts = F.split(node, "_", 3)
    return F.when(node.startswith("repo_"), node.substr(F.lit(6), F.length(node))).when((F.size(parts) >= 2) & parts[0].isin(*ID_PREFIXES), parts[1])


def xml_name(x: Column) -> Column:
    """A name that XML takes as an identifier."""
    y = F.regexp_replace(F.translate(F.lower(x), " -:", "___"), r"[^\p{L}\p{N}_]", "")
    return F.when(y.rlike(r"^[\p{L}_]"), y).otherwise(F.concat(F.lit("id_"), y))


def singular(word: Column) -> Column:
    """The singular of an English noun by its ending.  Words without one stay, irregular
    ones keep a capital at their begin."""
    low = F.lower(word)
    odd = lookup(IRREGULAR)[low]
    odd = F.when(word.rlike(r"^\p{Lu}"), F.initcap(odd)).otherwise(odd)
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    return (
        F.when(low.isin(*UNCOUNTABLE), word)
        .when(odd.isNotNull(), odd)
        .when(low.rlike(r"[^aeiou]ies$"), F.concat(cut(3), F.when(word.rlike(r"I..$"), "Y").otherwise("y")))
        .when(low.rlike(r"(s|x|z|ch|sh)es$"), cut(2))
        .when(low.rlike(r"[^s]s$") & (F.length(word) > 2), cut(1))
        .otherwise(word)
    )


def concept_name(x: Column) -> Column:
    """Words at underscores and blanks, the last in the singular, each capitalised, joined."""
    words = F.filter(F.split(x, r"[_\s]+"), lambda w: w != "")
    n = F.size(words)
    last = F.when(n > 0, F.element_at(words, -1))
    init = F.transform(F.when(n > 1, F.slice(words, 1, n - 1)).otherwise(F.array()), F.initcap)
    return F.concat(F.array_join(init, ""), F.coalesce(F.initcap(singular(last)), F.lit("")))


def package_name(x: Column) -> Column:
    """The name less the first ending that fits, in the spelling known for it, else as it
    is written."""
    low = F.lower(x)
    base = None
    for e in PACKAGE_ENDINGS:
        less = x.substr(F.lit(1), F.length(x) - len(e))
        base = F.when(low.endswith(e), less) if base is None else base.when(low.endswith(e), less)
    base = base.otherwise(x)
    return F.coalesce(lookup(PACKAGES)[F.lower(base)], base)


def dependency_id(repository: Column, name: Column) -> Column:
    """Node id of a dependency, of its normal name: blanks, dashes and slashes become
    underscores, other signs stay."""
    return F.concat(F.lit("extdep_"), repository, F.lit("_"), F.translate(F.lower(name), "- /", "___"))


def content_hash(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def cache_key(prompt: Column, model: Column, schema: Column | None = None, bench: Column | None = None) -> Column:
    parts = [prompt, model] + ([schema] if schema is not None else []) + ([F.concat(F.lit("bench:"), bench)] if bench is not None else [])
    return F.sha2(F.concat_ws("|", *parts), 256)


def run_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def run_parts(x: Column) -> Column:
    """session, model, repository, iteration of a run id of at least four parts whose
    last is a number, else null."""
    p = F.split(x, ":")
    it = F.element_at(p, -1).try_cast("int")
    return F.when((F.size(p) >= 4) & it.isNotNull(), F.struct(p[0].alias("session"), p[1].alias("model"), p[2].alias("repository"), it.alias("iteration")))


def lemma(word: Column) -> Column:
    """The word with the first ending that fits replaced: verbs' endings, then nouns'.
    Three letters must be left of it, and three before the ending; shorter words stay."""
    out = F.when(F.length(word) <= 3, word)
    for end, new in (*VERB_ENDINGS, *NOUN_ENDINGS):
        fits = word.endswith(end) & (F.length(word) > len(end) + 2)
        out = out.when(fits, F.concat(word.substr(F.lit(1), F.length(word) - len(end)), F.lit(new)))
    return out.otherwise(word)


def normal_name(x: Column, synonyms: dict[str, str] | None = None, lemmas: bool = False) -> Column:
    """Lower case, without leading articles, underscores and dashes as blanks, each word
    replaced by its lemma (if asked for), then by its synonym; null and empty names give
    an empty one.  Synonyms of several words match no single word."""
    means = lookup(SYNONYMS | (synonyms or {}))
    y = stripped(F.lower(F.coalesce(x, F.lit(""))))
    for article in ("the", "a", "an"):
        y = F.regexp_replace(y, f"^{article} ", "")
    y = F.trim(F.regexp_replace(y, r"[_\-\s]+", " "))
    one = (lambda w: F.coalesce(means[lemma(w)], lemma(w))) if lemmas else (lambda w: F.coalesce(means[w], w))
    return F.array_join(F.transform(F.split(y, " "), one), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; 1 for two empty texts, 0 for one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def json_of(response: Column) -> Column:
    """The JSON in a response: a fenced block, else the text if it begins with a bracket,
    else its widest object, else the text."""
    fenced = F.nullif(stripped(F.regexp_extract(response, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)), F.lit(""))
    whole = F.when(stripped(response).rlike(r"^[\[{]"), stripped(response))
    inside = F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, whole, inside, response)


def without_fence(x: Column) -> Column:
    """The text within a code fence that holds all of it, with or without line ends."""
    inside = stripped(x)
    return F.when(inside.rlike(r"(?s)^```(\w*)\s*(.*?)\s*```$"), F.regexp_extract(inside, r"(?s)^```(?:\w*)\s*(.*?)\s*```$", 1)).otherwise(x)


def iso_time(t: Column) -> Column:
    """UTC time as text of ISO 8601, with microseconds where there are any."""
    u = F.to_utc_timestamp(t, F.current_timezone())
    return F.concat(F.date_format(u, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(u, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(u, "SSSSSS"))).otherwise(""), F.lit("Z"))


def duration_ms(begin: Column, end: Column) -> Column:
    """Whole milliseconds from begin to end."""
    return F.floor((F.unix_micros(end) - F.unix_micros(begin)) / 1000)


def token_estimate(x: Column) -> Column:
    return F.floor(F.coalesce(F.length(x), F.lit(0)) / 4)


def shortened(x: Column, tokens: int) -> Column:
    """Head and tail of a text over the estimate: lines for max(10, tokens * 4 // 40), three
    fifths of them from the head, with a line that says how many are left out."""
    target = max(10, tokens * 4 // 40)
    head = int(target * 0.6)
    tail = target - head
    lines = F.split(x, "\n")
    n = F.size(lines)
    mark = F.concat(F.lit("\n\n... ["), (n - target).cast("string"), F.lit(" lines truncated] ...\n\n"))
    cut = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), mark, F.array_join(F.slice(lines, n - tail + 1, tail), "\n"))
    return F.when((token_estimate(x) > tokens) & (n > target), cut).otherwise(x)


def coerced(x: Column, allowed: list[str], default: str | None) -> Column:
    """The value in lower case if it is allowed, else the default."""
    return F.when(F.lower(F.trim(x)).isin(*allowed), F.lower(F.trim(x))).otherwise(F.lit(default))
