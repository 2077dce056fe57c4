"""Cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, width

#: Characters per token where only lengths are known.
TOKEN_CHARS = 4
#: Characters of one range that a worker looks at, besides its halo.
RANGE_CHARS = 1 << 20


def limits(files: DataFrame, registry: DataFrame) -> DataFrame:
    """node_id, delimiter, max_tokens, overlap by the registry row of the suffix (the
    lower-cased end of the path from its last dot).  Nodes without a row, or whose row
    has no limit, are left out.  Of several rows of one suffix or several paths of one
    node the least counts."""
    suffix = F.lower(F.regexp_extract("file_path", r"(\.[^.]*)$", 1))
    one = registry.where("extension is not null").groupBy(F.col("extension").alias("suffix")).agg(
        F.min(F.struct("chunk_max_tokens", "chunk_delimiter", "chunk_overlap")).alias("r")
    )
    nodes = files.where("node_id is not null").groupBy("node_id").agg(F.min("file_path").alias("file_path")).withColumn("suffix", suffix)
    return nodes.join(one.where("r.chunk_max_tokens is not null"), "suffix").select(
        "node_id", F.col("r.chunk_delimiter").alias("delimiter"), F.col("r.chunk_max_tokens").alias("max_tokens"), F.coalesce("r.chunk_overlap", F.lit(0)).alias("overlap")
    )


def oversized(files: DataFrame, texts: DataFrame, registry: DataFrame) -> DataFrame:
    """node_id, n_chars, delimiter, max_tokens, overlap, content of the texts with more
    than max_tokens tokens, a token being four characters, rounded down.  Null texts
    have no size; a limit below nothing is no limit."""
    sized = texts.where("content is not null").select("node_id", "content", F.length("content").alias("n_chars"))
    return sized.join(limits(files, registry), "node_id").where((F.col("max_tokens") > 0) & (F.floor(F.col("n_chars") / TOKEN_CHARS) > F.col("max_tokens"))).select(
        "node_id", "n_chars", "delimiter", "max_tokens", "overlap", "content"
    )


# ---------------------------------------------------------------- boundaries in ranges
def _cut_offset(delimiter: str) -> int:
    """Where within a delimiter the text is cut: after it if it ends a line, else
    before its first mark that is no line end."""
    if delimiter.endswith("\n"):
        return len(delimiter)
    return len(delimiter) - len(delimiter.lstrip("\n"))


_LINE_END = re.compile(r"\r\n|\n|\r")


def halo_chars(delimiter: str | None) -> int:
    """Characters that a range must see on both sides: a delimiter less one, and one
    for a line end of two characters."""
    return max(len(delimiter or "") - 1, 1)


def boundaries(text: str, begin: int, length: int, delimiter: str | None) -> tuple[list[int], list[int]]:
    """Cuts at line ends and at delimiters that lie in (begin, begin + length] of a
    file, found in one range of it; ``text`` holds the range and its halos, as far as
    there is text before and after."""
    base, last = begin - min(begin, halo_chars(delimiter)), begin + length  # what lies beyond is looked at, not cut at
    lines = [c for m in _LINE_END.finditer(text) if begin < (c := base + m.end()) <= last]
    sections = []
    if delimiter:
        off = _cut_offset(delimiter)
        at = text.find(delimiter)
        while at >= 0:
            cut = base + at + off
            if begin < cut <= last:
                sections.append(cut)
            at = text.find(delimiter, at + 1)
    return lines, sections


def _step(max_tokens: Column) -> Column:
    """Characters of a range: RANGE_CHARS, or a whole piece where that is longer."""
    return F.greatest(F.lit(RANGE_CHARS), max_tokens * TOKEN_CHARS + TOKEN_CHARS).cast("int")


def range_table(large: DataFrame) -> DataFrame:
    """node_id, begin, chars, left, delimiter, max_tokens, text: the ranges of each text,
    with halos: ``left`` characters before it, and after it as many as the longest piece
    that begins in it may still take.  The text of a row is walked through once, by the
    task that reads it; all that follows sees ranges only, so a giant text is as many
    tasks as it has ranges."""
    step = _step(F.col("max_tokens"))
    halo = F.greatest(F.length(F.coalesce("delimiter", F.lit(""))) - 1, F.lit(1))
    whole = large.withColumn("step", step).withColumn("parts", F.regexp_extract_all("content", F.concat(F.lit("(?s).{1,"), F.col("step").cast("string"), F.lit("}+")), 0))
    each = whole.select("node_id", "delimiter", "max_tokens", "step", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("k"))
    own, near = F.get("parts", F.col("k")), lambda d: F.coalesce(F.get("parts", F.col("k") + d), F.lit(""))
    left = F.right(near(-1), halo)
    text = F.concat(left, own, F.left(near(1), F.greatest(halo, F.col("max_tokens") * TOKEN_CHARS + TOKEN_CHARS)))
    rows = each.select("node_id", (F.col("k") * F.col("step")).cast("int").alias("begin"), F.length(own).alias("chars"), F.length(left).alias("left"), "delimiter", "max_tokens", text.alias("text"))
    return rows.repartition(width(large.sparkSession, 2, large), "node_id", "begin")


def _range_boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [boundaries(t, a, n, d) for t, a, n, d in zip(b["text"], b["begin"], b["chars"], b["delimiter"])]
        yield pd.DataFrame({"node_id": b["node_id"], "begin": b["begin"], "lines": [x[0] for x in found], "sections": [x[1] for x in found]})


def plan_pieces(n_chars: int, lines: Sequence[int], sections: Sequence[int], max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (begin, end, characters shared with the piece before) of at most
    max_tokens tokens, from the cuts of the whole file.

    Units are sections; a section over the limit falls into its lines, a line over the
    limit into stretches of exactly the limit.  A piece takes units while they fit.  The
    next one begins ``overlap`` units earlier, or as few less as it takes for its first
    new unit to fit as well.
    """
    limit = max_tokens * TOKEN_CHARS + TOKEN_CHARS - 1
    ends = array("q")
    start, k = 0, 0
    for end in [*sections, n_chars] if not sections or sections[-1] < n_chars else sections:
        if end <= start:
            continue
        if end - start <= limit and sections:
            ends.append(end)
        else:
            lo, hi = bisect_right(lines, start), bisect_right(lines, end)
            for cut in [*lines[lo:hi], end]:
                while cut - start > limit:
                    start += limit
                    ends.append(start)
                if cut > start:
                    ends.append(cut)
                    start = cut
        start = end
    begins = array("q", [0]) + ends[:-1]
    out, i, shared = [], 0, 0
    while i < len(ends):
        j = bisect_right(ends, begins[i] + limit) - 1
        out.append((begins[i], ends[j], shared))
        if j + 1 >= len(ends):
            break
        k = max(i + 1, j + 1 - overlap)
        while k <= j and ends[j + 1] - begins[k] > limit:
            k += 1
        i, shared = k, ends[j] - begins[k]
    return out


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boundary tables of a text's ranges to its pieces, listed by the range they begin in."""
    for b in batches:
        out = []
        for node, chars, most, overlap, step, ranges in zip(b["node_id"], b["n_chars"], b["max_tokens"], b["overlap"], b["step"], b["ranges"]):
            lines, sections = array("q"), array("q")
            for r in ranges:
                lines.extend(map(int, r["lines"]))
                sections.extend(map(int, r["sections"]))
            plan = plan_pieces(int(chars), lines, sections, int(most), int(overlap))
            at = 0
            while at < len(plan):
                begin, to = plan[at][0] // step * step, at
                while to < len(plan) and plan[to][0] < begin + step:
                    to += 1
                own = plan[at:to]
                out.append((node, begin, at, len(plan), [p[0] for p in own], [p[1] for p in own], [p[2] for p in own]))
                at = to
        yield pd.DataFrame(out, columns=["node_id", "begin", "first", "pieces", "begins", "ends", "shared"])


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for node, text, at, left, first, begins, ends, shared in zip(b["node_id"], b["text"], b["begin"], b["left"], b["first"], b["begins"], b["ends"], b["shared"]):
            base = at - left
            yield pd.DataFrame(
                {"node_id": node, "piece_no": range(first, first + len(begins)), "begin_char": begins, "end_char": ends, "shared_chars": shared, "text": [text[x - base : y - base] for x, y in zip(begins, ends)]}
            )


def planned(large: DataFrame, ranges: DataFrame) -> DataFrame:
    """node_id, begin, first, pieces, begins, ends, shared: the pieces of each oversized
    text by offset, one row for each range that a piece begins in: the number of its
    first piece, and of all pieces of the text."""
    facts = large.select("node_id", "n_chars", "max_tokens", "overlap", _step(F.col("max_tokens")).alias("step"))
    found = ranges.mapInPandas(_range_boundaries, "node_id string, begin int, lines array<int>, sections array<int>")
    tables = found.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("begin", "lines", "sections"))).alias("ranges"))
    return tables.join(facts, "node_id").mapInPandas(_stitch, "node_id string, begin int, first int, pieces int, begins array<int>, ends array<int>, shared array<int>")


def cut_files(large: DataFrame) -> DataFrame:
    """node_id of the texts that are cut into more than one piece."""
    return planned(large, range_table(large)).where("first = 0 and pieces > 1").select("node_id")


def pieces(files: DataFrame, texts: DataFrame, registry: DataFrame) -> DataFrame:
    """node_id, piece_no, begin_char, end_char, shared_chars, text of the pieces of all
    oversized texts: each of at most max_tokens tokens, cut at section or line ends
    where the limit allows it, and beginning with the last ``overlap`` units of the one
    before.  Pieces without their first shared_chars characters give back the text.

    Workers look for boundaries in ranges of a text with halos, so one giant file is
    many tasks; the boundary tables of its ranges are stitched (offsets are kept, so
    lengths are their differences), and each range emits the pieces that begin in it by
    their offsets, its halo being as long as the longest piece.  Only a boundary table
    is ever gathered per text: eight bytes a line.  Texts within the limit give no rows.
    """
    large = oversized(files, texts, registry)
    ranges = cut(range_table(large))
    plan = planned(large, ranges)
    return ranges.select("node_id", "begin", "left", "text").join(plan, ["node_id", "begin"]).mapInPandas(
        _emit, "node_id string, piece_no int, begin_char int, end_char int, shared_chars int, text string"
    )
