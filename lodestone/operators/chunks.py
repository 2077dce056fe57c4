"""Cutting a text into chunks within a model's limit, for prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import MODEL_LIMITS
from ..plans.lineage import for_every_core
from .ranking import first_of

def model_limit(model: str | None, share: float = 0.8) -> int:
    """Tokens a chunk may have: the limit of the model's name in any case, else of the
    first name that is part of it or that it is part of, else the default, times the share."""
    low = "default" if model is None else model.lower()
    near = (n for m, n in MODEL_LIMITS.items() if m in low or low in m)
    return int(MODEL_LIMITS.get(low, next(near, MODEL_LIMITS["default"])) * share)


def by_lines(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks that take lines until the next would not
    fit; each begins with the last ``overlap`` lines of the one before.  A line over
    the limit is a chunk of its own.  Lines end as str.splitlines has it."""
    lines = text.splitlines(keepends=True)
    out, begin, size = [], 0, 0
    for i, line in enumerate(lines):
        if i > begin and (size + len(line)) // 4 > limit:
            out.append((begin + 1, i, "".join(lines[begin:i])))
            begin = max(i - overlap, begin + 1)
            size = sum(map(len, lines[begin:i]))
        size += len(line)
    if lines:
        out.append((begin + 1, len(lines), "".join(lines[begin:])))
    return out


def by_delimiter(text: str, limit: int, delimiter: str, overlap: int = 0) -> list[tuple[int, int, str]]:
    """Like by_lines with sections that begin at the delimiter (the first at the text's
    begin; a delimiter with nothing behind it is dropped).  A section over the limit is
    cut by lines.  A chunk begins with the last ``overlap`` sections of the one before if
    that had so many.  Tokens are counted section by section; a chunk's last line is its
    first plus its line ends, the next chunk's first the one after."""
    first, *rest = text.split(delimiter)
    sections = [first] * bool(first) + [delimiter + x for x in rest if x]
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    begin = 1

    def flush() -> None:
        nonlocal begin
        chunk = "".join(held)
        end = begin + chunk.count("\n")
        out.append((begin, end, chunk))
        begin = end + 1

    for s in sections:
        if len(s) // 4 > limit:
            if held:
                flush()
                held = []
            out += [(begin + a - 1, begin + b - 1, c) for a, b, c in by_lines(s, limit, overlap)]
            begin += s.count("\n") + 1
            continue
        if held and (_tokens(held) + len(s) // 4) > limit:
            flush()
            held = held[-overlap:] if 0 < overlap <= len(held) else []
        held.append(s)
    if held:
        flush()
    return out


def _tokens(sections: list[str]) -> int:
    return sum(len(x) // 4 for x in sections)


def labelled(chunks: DataFrame, path: str = "file_path") -> DataFrame:
    """The chunks with ``label``: the path, and of a file in several chunks the lines as well."""
    lines = F.concat(F.col(path), F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    return chunks.withColumn("label", F.when(F.col("chunks") > 1, lines).otherwise(F.col(path)))


def once_per_file(nodes: DataFrame, order: str = "chunk_no") -> DataFrame:
    """Nodes read from the chunks of files (file, node_id, ...): each once per file, that
    of the first chunk; nodes without id are dropped."""
    return first_of(nodes, ["file", "node_id"], [F.col(order)])


def chunked(texts: DataFrame, limit: int, delimiter: str | None = None, overlap: int = 0) -> DataFrame:
    """node_id, chunk_no, chunks, start_line, end_line, content.  A text within the limit
    is one chunk; null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for node, text in zip(b["node_id"], b["content"]):
                if len(text) // 4 <= limit:
                    got = [(1, max(1, len(text.splitlines())), text)] if text else []
                else:
                    got = by_delimiter(text, limit, delimiter, overlap) if delimiter else by_lines(text, limit, overlap)
                rows += [(node, k, len(got), *c) for k, c in enumerate(got)]
            yield pd.DataFrame(rows, columns=["node_id", "chunk_no", "chunks", "start_line", "end_line", "content"])

    some = for_every_core(texts.where("content is not null").select("node_id", "content"), "node_id")
    return some.mapInPandas(run, "node_id string, chunk_no int, chunks int, start_line int, end_line int, content string")
