"""Generated, minified, taken-over and data files among source files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .languages import KEYWORDS
from .source_files import with_texts

# File and folder names that only tools give.
TOOL_NAMES = re.compile(r"(_pb2(_grpc)?\.py|\.pb\.go|\.(gen|generated)\.[a-z]+|_generated\.[a-z]+)$|(^|/)(generated-sources|__generated__)/", re.I)
MINIFIED_NAMES = re.compile(r"[.-]min\.(js|ts)$", re.I)
INSTALLED = re.compile(r"(^|/)node_modules/", re.I)
#: Folders in which other people's code often lies.  No mark by themselves: they only
#: lower the share of a text that must stand elsewhere.
VENDOR_FOLDERS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "external", "extern", "deps", "contrib", "bower_components")
# What a comment around the code says of a file that a tool wrote, ...
TOOL_PHRASES = re.compile(
    r"\bcode generated by .*\bdo not edit\b|<auto-?generated\b|@generated\b"
    r"|\bautogenerated\b.*\b(by|with|from|on)\b"
    r"|\b(this|the) (file|code|module|class) (was|is|has been) (auto-?|automatically |mechanically )?(generated|created|produced|written) ?(automatically )?(by|with|from)\b(?! hand)"
    r"|\b(auto-?|automatically )?(generated|produced)( automatically)? (by|with|from|on)\b.*\b(do not (edit|modify|change)|changes (will|would|may) be (lost|overwritten))",
    re.I,
)
#: ... and of one that comes from somewhere else.
ORIGIN_PHRASES = re.compile(
    r"\b(copied|vendored|imported|taken|bundled)( verbatim| unmodified| unchanged)? from (?P<a>[\w.-]*\w),? (v|version |release )?\d+(\.\d+)*\b|(?P<b>[\w.-]*\w) - part of the (?P=b) (distribution|project|library)\b",
    re.I,
)

#: Token composition.  Data: this share of the characters of all tokens stands in
#: numbers and unbroken strings.  Minified: names this short on average and so little
#: white space.  Written by a tool: so few different lines once numbers are alike, and
#: so many declared names with parameters that are the same but for their number.
DATA_SHARE, DATA_CHARS = 0.5, 150
SHORT_NAMES, SHORT_NAMES_COUNT, BLANK_SHARE = 2.6, 40, 0.1
LIKE_LINES, NUMBERED_NAMES = 0.32, 8

#: Share of a text (in characters of its different lines) that must stand in one text
#: of another repository, if nothing else speaks for a copy.
CONTAINED = 0.8
#: The same where the path names that repository or a folder of other people's code.
HINTED_CONTAINED = 0.6
#: Characters below which a text says nothing of its origin unless its path names it,
#: and below which it does not even in a folder of other people's code.
TELLING_CHARS, HINTED_CHARS = 300, 100
#: Different texts with a line up to which all of them are compared at once; of more,
#: so many at first, the earliest, and then so many times as many from round to round.
HOT_LINE, FIRST_HOLDERS, MORE_HOLDERS = 200, 16, 4


# ---------------------------------------------------------------- what the tokens are
@lru_cache(maxsize=None)
def _tokens(language: str) -> re.Pattern:
    """Comment, string, number, name, anything else: one group each."""
    # strings are runs of plain characters between escapes, so that nothing is kept per character
    short = r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
    if language == "python":
        comment, text = r"\#[^\n]*", rf"[rRbBuUfF]{{0,2}}(?:\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''|{short})"
    else:
        comment, text = r"//[^\n]*|/\*.*?\*/", rf"{short}|`[^`\\]*(?:\\.[^`\\]*)*`"
    return re.compile(rf"({comment})|({text})|(\d[\w.]*)|([^\W\d]\w*)|[^\s\w]", re.S)


_SIGN = ("", "", "", "")
_BLANK, _DIGITS = re.compile(r"\s"), re.compile(r"\d+")
_MARK = re.compile(r"^\s*(?://+|\#+|/?\*+)[ \t]?", re.M)
_NUMBERED = re.compile(r"([^\W\d]\w*?)(\d+)\s*\(")


def composition(language: str, text: str, found: list[tuple] | None = None) -> str | None:
    """``data``, ``minified`` or ``generated`` by what the tokens are, else null."""
    found = _tokens(language).findall(text) if found is None else found
    words = KEYWORDS[language]
    comments, strings, numbers, all_names = ("".join(x) for x in zip(*found)) if found else ("", "", "", "")
    names = [t[3] for t in found if t[3] and t[3] not in words]
    signs = sum(1 for t in found if t == _SIGN)
    body = len(strings) + len(numbers) + len(all_names) + signs
    literal = len(numbers) + sum(len(t[1]) for t in found if len(t[1]) > 20 and not _BLANK.search(t[1]))
    if body >= DATA_CHARS and literal >= DATA_SHARE * body:
        return "data"
    blanks = len(text) - body - len(comments)
    if len(names) >= SHORT_NAMES_COUNT and blanks <= BLANK_SHARE * (body + blanks) and sum(map(len, names)) <= SHORT_NAMES * len(names):
        return "minified"
    ends: dict[str, set] = {}
    for n in set(names):
        if n[-1].isdecimal():
            bare = n.rstrip("0123456789")
            ends.setdefault(bare, set()).add(n)
    if any(len(x) >= NUMBERED_NAMES for x in ends.values()):
        numbered: dict[str, set] = {}
        for name, number in _NUMBERED.findall(text):
            numbered.setdefault(name, set()).add(number)
        if any(len(x) >= NUMBERED_NAMES for x in numbered.values()):
            lines = [_DIGITS.sub("9", x.strip()) for x in text.split("\n") if x.strip()]
            if len(set(lines)) <= LIKE_LINES * len(lines):
                return "generated"
    return None


def around_code(found: list[tuple]) -> list[str]:
    """The comments before the first and after the last token of code."""
    first = next((i for i, t in enumerate(found) if not t[0]), len(found))
    last = next((i for i in range(len(found) - 1, -1, -1) if not found[i][0]), -1)
    return [t[0] for t in found[:first] + found[max(last, first - 1) + 1 :]]


def marks(path: str, repository: str | None, found: list[tuple]) -> str | None:
    """What names that only tools give and the comments around the code say."""
    if MINIFIED_NAMES.search(path):
        return "minified"
    if TOOL_NAMES.search(path):
        return "generated"
    if INSTALLED.search(path):
        return "taken over"
    comments = around_code(found)
    if not comments:
        return None
    # lines of one comment are read together, without the marks that begin them
    said = " ".join(_MARK.sub("", c).replace("\n", " ") for c in comments)
    if TOOL_PHRASES.search(said):
        return "generated"
    m = ORIGIN_PHRASES.search(said)
    return "taken over" if m and repository not in (m["a"], m["b"]) else None


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .languages import normalise

    for b in batches:
        out = []
        for lang, path, repo, text in zip(b["language"], b["file_path"], b["repository_name"], b["content"]):
            text = normalise(text)
            found = _tokens(lang).findall(text)
            out.append(marks(path, repo, found) or composition(lang, text, found))
        yield pd.DataFrame({"node_id": b["node_id"], "repository_name": b["repository_name"], "reason": out})


# ---------------------------------------------------------------- where the lines stand
def _lines(content: Column) -> Column:
    """h, w: hash and characters of each different line, white space squeezed, blank
    lines and a leading byte order mark left out."""
    rows = F.transform(F.split(F.regexp_replace(content, "^﻿", ""), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(F.array_distinct(F.filter(rows, lambda x: x != "")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("w")))


def line_table(files: DataFrame, texts: DataFrame) -> DataFrame:
    """node_id, repository_name, moment, named, hinted, lines, weight, form of each file.
    ``form`` is a hash of the set of lines: files with the same lines are one form.
    ``named``: folders of the path, and those less a version at their end, that may be
    names of repositories."""
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    lines = _lines(F.col("content"))
    rows = with_texts(files, texts, "repository_name", "created_at").select("node_id", "repository_name", F.col("created_at").alias("moment"), folders.alias("folders"), lines.alias("lines"))
    named = F.array_distinct(F.flatten(F.transform("folders", lambda x: F.array(x, F.regexp_replace(x, r"-\d+(\.\d+)*$", "")))))
    hinted = F.exists("folders", lambda x: F.lower(x).isin(*VENDOR_FOLDERS))
    weight = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    form = F.xxhash64(F.array_sort(F.transform("lines", lambda x: x["h"])))
    return rows.select("node_id", "repository_name", "moment", F.array_except(named, F.array("repository_name")).alias("named"), hinted.alias("hinted"), "lines", weight.alias("weight"), form.alias("form"))


def containment(forms: DataFrame, hot_line: int = HOT_LINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From forms (form, weight, share, lines; those of no share are only looked for as
    others): pairs (form, other, share of the form's weight that stands in the other),
    exact for every pair that reaches the form's ``share`` and has one of the form's
    rarest lines that at most ``hot_line`` forms have; the lines that several forms have
    (form, h, w, n); and the form and line (form, h) of the rarest lines that more forms
    have, for ``_held_by_any``.

    An inverted index of the lines gives the number of forms per line.  A line that one
    form has stands nowhere else, so only forms whose other lines weigh enough go on.
    Of these, any form that holds the share holds one of the form's rarest lines, of
    which so many are taken that the rest weighs less than the share: only those are
    looked up, and each pair found is counted exactly, line by line.
    """
    index = forms.select("form", F.explode("lines").alias("l")).select("form", "l.h", "l.w")
    often = index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(index.join(often, "h"))
    facts = forms.select("form", "weight", "share")
    some = shared.groupBy("form").agg(F.sum("w").alias("held")).join(facts, "form").where("held > 0 and held >= share * weight").select("form", "weight", "share", "held")
    some = cut(some)
    from pyspark.sql import Window

    before = F.sum("w").over(Window.partitionBy("form").orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1))
    ordered = shared.join(some, "form").withColumn("before", F.coalesce(before, F.lit(0)))
    rarest = cut(ordered.where("weight - held + before <= (1 - share) * weight + 0.001").select("form", "h", "n"))
    asked = rarest.where(F.col("n") <= hot_line).select("form", "h").join(shared.where(F.col("n") <= hot_line).select(F.col("form").alias("other"), "h"), "h").where("form <> other").select("form", "other").distinct()
    pairs = _counted(asked, shared).join(some, "form").where("k >= share * weight").select("form", "other", (F.col("k") / F.col("weight")).alias("contained"))
    return cut(pairs), shared, rarest.where(F.col("n") > hot_line).select("form", "h")


def _counted(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """form, other, k: what the form weighs that stands in the other."""
    both = pairs.join(shared.select("form", "h", "w"), "form").join(shared.select(F.col("form").alias("other"), "h"), ["other", "h"])
    return both.groupBy("form", "other").agg(F.sum("w").alias("k"))


def _held_by_any(asks: DataFrame, posted: DataFrame, shared: DataFrame, timed: bool) -> DataFrame:
    """form, key of the asks of which any text posted under the key holds ``need``.

    Asks: form, key, h (each of the form's rarest lines), need, at.  Posted: key, h,
    other, at (a text that has the line, and when which repository had it first).
    ``timed``: only texts of other repositories that were there before the ask's ``at``
    count; the form must be posted itself with that ``at``, beyond which nothing is
    looked at.

    The texts of a line are compared in the order of ``at``, some at first and more from
    round to round, until one holds the form or all have been compared: exact, though
    copies of one text, however many, seldom need more than its first holders."""
    from pyspark.sql import Window

    here = posted.join(asks.select("key", "h").distinct(), ["key", "h"], "left_semi")
    places = cut(here.withColumn("place", F.row_number().over(Window.partitionBy("key", "h").orderBy("at", "other"))))
    if timed:
        last = places.select("key", "h", F.col("other").alias("form"), "at", F.col("place").alias("last"))
        left = asks.join(last, ["key", "h", "form", "at"])
    else:
        left = asks.join(places.groupBy("key", "h").agg(F.max("place").alias("last")), ["key", "h"])
    left, found, low, high = cut(left), None, 0, FIRST_HOLDERS
    while not left.isEmpty():
        near = left.join(places.where((F.col("place") > low) & (F.col("place") <= high)).withColumnRenamed("at", "then"), ["key", "h"]).where("form <> other and place <= last")
        if timed:
            near = near.where("then.repository_name <> at.repository_name and then < at")
        near = cut(near.select("form", "key", "need", "other").distinct())
        held = cut(near.join(_counted(near.select("form", "other").distinct(), shared), ["form", "other"]).where("k >= need").select("form", "key").distinct())
        found = held if found is None else found.unionByName(held)
        left = cut(left.where(F.col("last") > high).join(held, ["form", "key"], "left_anti"))
        low, high = high, high * MORE_HOLDERS
    return asks.select("form", "key").where("false") if found is None else found


def _two_first(rows: DataFrame, key: str) -> DataFrame:
    """key, a, b: the earliest (moment, repository_name) and the earliest of another
    repository, null if there is none.  Rows: key, at (that struct)."""
    first = rows.groupBy(key).agg(F.min("at").alias("a"))
    second = rows.join(first, key).where("at.repository_name <> a.repository_name").groupBy(key).agg(F.min("at").alias("b"))
    return first.join(second, key, "left")


def taken_over(base: DataFrame, hot_line: int = HOT_LINE) -> DataFrame:
    """node_id of the copies among the rows of ``line_table``.

    1. A file whose path names another repository is a copy if that repository has a
       text that holds HINTED_CONTAINED of it.
    2. Any other file of TELLING_CHARS characters is a copy if a text of another
       repository that was there before its own repository had the file holds
       CONTAINED of it (HINTED_CONTAINED in a folder of other people's code).  Copies
       by 1 are no such text, so that an original is no case.  A shorter file in such
       a folder, of HINTED_CHARS at least, is a copy if its whole text was there before.

    Where more than ``hot_line`` different texts have one of a file's rarest lines, they
    are compared from the earliest on until one is found that holds it, all if none does.

    Files are compared as forms (sets of lines), with their two earliest repositories,
    so a group of equal copies costs one form however large it is.
    """
    known = base.where("repository_name is not null")
    repositories = known.select(F.col("repository_name").alias("other_repository")).distinct()
    asked = base.where("weight > 0").select("node_id", "form", F.explode("named").alias("other_repository")).join(repositories, "other_repository")
    asked = cut(asked)
    named_forms = asked.select("form", F.lit(True).alias("is_named")).distinct()
    one = base.where("weight > 0").groupBy("form").agg(F.min("node_id").alias("node_id"), F.max("hinted").alias("hinted"))
    forms = one.join(base.select("node_id", "lines", "weight"), "node_id").join(named_forms, "form", "left")
    lower = F.col("hinted") | F.coalesce("is_named", F.lit(False))
    forms = forms.select("form", "weight", "lines", "is_named", F.when(lower, HINTED_CONTAINED).otherwise(CONTAINED).alias("share"))
    asking = (F.col("weight") >= TELLING_CHARS) | F.coalesce("is_named", F.lit(False))
    pairs, shared, hot = containment(forms.withColumn("share", F.when(asking, F.col("share"))).drop("is_named"), hot_line)
    hot = cut(hot)
    some_hot = not hot.isEmpty()
    posted_lines = shared.join(hot.select("h").distinct(), "h", "left_semi").select(F.col("form").alias("other"), "h") if some_hot else None

    holders = known.groupBy("form", "repository_name").agg(F.min("moment").alias("moment"))
    every = pairs.select("form", "other").unionByName(named_forms.select("form", F.col("form").alias("other")))
    there = asked.select("form", "other_repository").distinct().join(every, "form").join(holders.select(F.col("form").alias("other"), F.col("repository_name").alias("other_repository")), ["other", "other_repository"])
    there = there.select("form", "other_repository").distinct()
    if some_hot:
        there = cut(there)
        named = asked.select("form", "other_repository").distinct().join(there, ["form", "other_repository"], "left_anti").join(hot, "form").join(forms.select("form", "weight"), "form")
        asks = cut(named.select("form", F.col("other_repository").alias("key"), "h", (HINTED_CONTAINED * F.col("weight")).alias("need"), F.lit(0).alias("at")))
        posted = holders.select(F.col("form").alias("other"), F.col("repository_name").alias("key")).join(posted_lines, "other").withColumn("at", F.lit(0))
        there = there.unionByName(_held_by_any(asks, posted, shared, False).withColumnRenamed("key", "other_repository"))
    by_name = cut(asked.join(there, ["form", "other_repository"]).select("node_id").distinct())

    rest = known.where("weight > 0").join(by_name, "node_id", "left_anti")
    telling = F.col("weight") >= F.when(F.col("hinted"), HINTED_CHARS).otherwise(TELLING_CHARS)
    own = cut(rest.groupBy("form", "repository_name").agg(F.min("moment").alias("moment"), F.max("hinted").alias("hinted")))
    at = F.struct("moment", "repository_name")
    firsts = cut(_two_first(own.select("form", at.alias("at")), "form"))
    near = pairs.join(firsts.select(F.col("form").alias("other"), "a", "b"), "other").select("form", "contained", F.explode(F.array_compact(F.array("a", "b"))).alias("at"))
    sources = near.unionByName(firsts.select("form", F.lit(1.0).alias("contained"), F.explode(F.array_compact(F.array("a", "b"))).alias("at")))
    # what is enough for a file in a vendor folder or for any: the two earliest of both
    enough = sources.select(F.when(F.col("contained") >= CONTAINED, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))).alias("h"), "form", "at").select("form", F.explode("h").alias("hinted"), "at")
    earliest = _two_first(enough.select(F.struct("form", "hinted").alias("key"), "at"), "key").select("key.form", "key.hinted", "a", "b")
    earlier = F.when(F.col("a.repository_name") != F.col("repository_name"), F.col("a")).otherwise(F.col("b"))
    copied = own.join(earliest, ["form", "hinted"]).where(earlier < at).select("form", "repository_name")
    if some_hot:
        copied = cut(copied)
        # where several repositories have a form, all but the first are copies by now
        once = own.join(firsts.select("form", "a"), "form").where(at == F.col("a")).join(copied, ["form", "repository_name"], "left_anti")
        need = F.when(F.col("hinted"), HINTED_CONTAINED).otherwise(CONTAINED) * F.col("weight")
        asks = cut(once.join(forms.select("form", "weight"), "form").where(telling).join(hot, "form").select("form", F.lit("").alias("key"), "h", need.alias("need"), F.col("a").alias("at")))
        posted = firsts.select(F.col("form").alias("other"), F.explode(F.array_compact(F.array("a", "b"))).alias("at")).join(posted_lines, "other").withColumn("key", F.lit(""))
        held = _held_by_any(asks, posted, shared, True).select("form")
        copied = copied.unionByName(firsts.join(held, "form").select("form", F.col("a.repository_name").alias("repository_name")))
    found = rest.where(telling).join(copied.distinct(), ["form", "repository_name"]).select("node_id")
    return by_name.unionByName(found).distinct()


def file_origins(files: DataFrame, texts: DataFrame) -> DataFrame:
    """node_id, repository_name, reason of every source file whose text could be read;
    ``reason`` is ``generated``, ``minified``, ``taken over``, ``data`` or null for
    files written by hand.

    First the inverted index of lines finds what stands in other repositories too
    (taken_over).  The files that remain are judged by names that only tools give, the
    comments around their code, and their token composition.

    Every line counts, however short, and however many files hold it; every file is
    judged whole.  A folder is no mark but for those that only tools make.  Null
    repository: by its own text only.  Empty texts: by hand.  Ties of time: the lower
    repository name.  A null time is earlier than any other.
    """
    base = cut(line_table(files, texts))
    copies = cut(taken_over(base))
    remain = with_texts(files, texts, "repository_name").join(copies, "node_id", "left_anti").select("node_id", "language", "file_path", "repository_name", "content")
    judged = remain.mapInPandas(_judged, "node_id string, repository_name string, reason string")
    return judged.unionByName(base.join(copies, "node_id").select("node_id", "repository_name", F.lit("taken over").alias("reason")))


def not_handwritten(files: DataFrame, texts: DataFrame) -> DataFrame:
    """node_id of the files that people did not write in their repository."""
    return file_origins(files, texts).where("reason is not null").select("node_id")


def origin_report(files: DataFrame, texts: DataFrame) -> DataFrame:
    """repository_name, reason (``by hand`` for null), files, share of the repository."""
    from pyspark.sql import Window

    counts = file_origins(files, texts).groupBy("repository_name", F.coalesce("reason", F.lit("by hand")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    return counts.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy("repository_name")))
