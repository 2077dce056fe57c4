"""Pages of repeated keywords, links, tags or products instead of sentences."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, for_every_core

STATES = ("prose", "link list", "tag list", "menu")
#: Longest unit in words; longer lines are cut at sentence ends, else at this length.
UNIT_WORDS = 60
#: Words around a unit in which repetition is measured.
WINDOW_WORDS = 40
#: Documents on which the model is fitted: those with the least hashes.
FIT_DOCUMENTS = 2000
#: Share of a page's words beyond which it is flagged.
NON_PROSE = 0.5

_WORD = re.compile(r"[^\W_](?:[\w'’\-]*[^\W_])?")
#: Words of a unit with links: a target is one word.
_COUNTED = re.compile(r"[^\s,;|·•»()\[\]<>\"]*\w[^\s,;|·•»()\[\]<>\"]*")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"']+|(?<![\w/.])\.{0,2}/[\w.\-]+(?:/[\w.\-]+)*/?(?:[#?][\w=&%\-]+)*")
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|!?\[(?:[^\[\]]|\[[^\[\]]*\](?:\([^()]*\))?)*\]\([^()\s]*\)", re.I | re.S)
_END = re.compile(r"[.!?…][\"'”’)\]»]*\s*[|)\]]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]»]*\s+")
_ITEM = re.compile(r"[,;|/·•»]|\s[-–]\s|\s{2,}|(?=#\w)")
_PRODUCT = re.compile(r"\b\d+[.,]\d\d\b|[$€£]\s?\d|\b(?:sku|ean|isbn)\b\W*\d", re.I)
_HEADING = re.compile(r"#{1,6}\s")
_LEAD = re.compile(r"^(?:[-*+•>]+|\d+[.)]|\[[\d: ]+\]|\|)\s+")


_LINES = re.compile(r"\r\n|\n|\r|\u2028|\u2029|<br\s*/?>")


def _without_code(lines: list[str]) -> list[str]:
    """Lines less those in code fences.  A fence ends at a line of its own mark and nothing
    else; one that ends on its own line, or never, is text."""
    ends: list[dict[str, int]] = [{}] * len(lines)  # per line: the next end of each mark
    near: dict[str, int] = {}
    for i in range(len(lines) - 1, -1, -1):
        ends[i] = near
        if lines[i][:3] in ("```", "~~~") and not lines[i].strip(lines[i][0]):
            near = {**near, lines[i][0]: i}
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if line[:3] in ("```", "~~~") and line[:3] not in line.lstrip(line[0]) and line[0] in ends[i]:
            i = ends[i][line[0]] + 1
            continue
        out.append(line)
        i += 1
    return out


def units(text: str) -> list[str]:
    """Lines without those in code fences; long lines in stretches of sentences."""
    out = []
    for line in _without_code([" ".join(x.split()) for x in _LINES.split(text)]):
        if not line:
            continue
        if line.count(" ") < UNIT_WORDS:
            out.append(line)
            continue
        part: list[str] = []
        n = 0
        for s in _SENTENCE.split(line):
            w = s.split()
            if n and n + len(w) > UNIT_WORDS:
                out.append(" ".join(part))
                part, n = [], 0
            while len(w) > UNIT_WORDS:
                out.append(" ".join(w[:UNIT_WORDS]))
                w = w[UNIT_WORDS:]
            part += w
            n += len(w)
        if part:
            out.append(" ".join(part))
    return out


def features(lines: list[str]) -> list[tuple[int, tuple[int, ...]]]:
    """Number of words and observed values of each unit: links, repetition around it,
    share of its commonest pair of words, sentence, separators (of units that are no
    sentence), length, heading, product."""
    bare, tokens = [], []
    for line in lines:
        b = _LEAD.sub("", line)
        if "](" in b or "<a" in b or "<A" in b:
            b = _ANCHOR.sub(" \x00 ", b)
        if "/" in b or "www." in b:
            b = _URL.sub(" \x00 ", b)
        bare.append(b)
        tokens.append(_WORD.findall(b.lower()))
    flat = [w for t in tokens for w in t]
    total, begin, out = len(flat), 0, []
    for line, b, t in zip(lines, bare, tokens):
        m = len(t)
        end = begin + m
        # the unit with as much of what stands around it as fills the window
        lo = max(0, min(begin - max(0, WINDOW_WORDS - m) // 2, total - WINDOW_WORDS))
        window = flat[lo : max(end, lo + WINDOW_WORDS)]
        size = len(window)
        if size > WINDOW_WORDS:
            distinct = (len(set(window[:WINDOW_WORDS])) + len(set(window[-WINDOW_WORDS:]))) / (2 * WINDOW_WORDS)
        else:
            distinct = len(set(window)) / size if size >= 12 else 1.0
        top = 2 * max(Counter(zip(window, window[1:])).values()) / size if size >= 12 else 0.0
        links = b.count("\x00")
        sentence = m >= 4 and bool(_END.search(b.replace("\x00", " ") if links else b[-12:]))
        items = 0 if sentence else len([x for x in _ITEM.split(_LEAD.sub("", line)) if x.strip()])
        out.append(
            (
                len(_COUNTED.findall(line)) if links else max(1, m),
                (
                    0 if not links else 1 if sentence and m >= 4 * links else 2,
                    0 if distinct <= 0.16 else 1 if distinct <= 0.24 else 2 if distinct <= 0.3 else 3 if distinct <= 0.38 else 4 if distinct <= 0.5 else 5,
                    0 if top <= 0.12 else 1 if top <= 0.2 else 2 if top <= 0.3 else 3 if top <= 0.4 else 4,
                    int(sentence),
                    0 if items < 3 else 1 if items <= 0.2 * m else 2 if items <= 0.35 * m else 3,
                    0 if m <= 2 else 1 if m <= 6 else 2 if m <= 14 else 3,
                    int(line[0] == "#" and bool(_HEADING.match(line))),
                    int(not sentence and bool(_PRODUCT.search(b))),
                ),
            )
        )
        begin = end
    return out


def seed(x: tuple[int, ...]) -> int | None:
    """State of a unit that leaves no doubt, for fitting."""
    links, distinct, top, sentence, items, length, heading, product = x
    if heading:
        return 0
    if product:
        return 3
    if distinct <= 1 or distinct == 2 and top >= 3 or top == 4:
        return 3 if length <= 1 else 2
    if links == 2:
        return 1
    if items >= 2 and not sentence and (length >= 2 or items == 3):
        return 2
    if sentence and distinct >= 3:
        return 0
    return None


#: Number of values of each feature.
VALUES = (3, 6, 5, 2, 4, 4, 2, 2)
#: Rounds of expectation and maximisation.
ROUNDS = 4
_COUNTS = "kind string, a int, b int, c int, n double"


def _observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The observations of each document, one number per unit."""
    for b in batches:
        codes = []
        for text in b["text"]:
            row = []
            for _, x in features(units(text)):
                code = 0
                for n, v in zip(VALUES, x):
                    code = code * n + v
                row.append(code)
            codes.append(row)
        yield pd.DataFrame({"codes": codes})


def _values(code: int) -> tuple[int, ...]:
    out = []
    for n in reversed(VALUES):
        code, v = divmod(code, n)
        out.append(v)
    return tuple(reversed(out))


def _expected(model: dict | None):
    """Expected counts of values per state and of steps under the model, forward and
    backward over each document.  A unit that leaves no doubt is in its state; without
    a model, only such units count."""
    k = len(STATES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        moves = np.exp(np.array(model["step"])) if model else np.full((k, k), 1 / k)
        moves /= moves.sum(axis=1, keepdims=True)
        steps = np.zeros((k, k))
        held: dict[int, np.ndarray] = {}  # per observation: likelihood of each state
        seen: dict[int, np.ndarray] = {}  # and how often it was in each
        for b in batches:
            for codes in b["codes"]:
                at = []
                for code in codes:
                    if code not in held:
                        x = _values(code)
                        s = seed(x)
                        if model is None:
                            row = np.zeros(k)
                            row[s if s is not None else slice(0)] = 1.0
                        else:
                            logs = np.array([sum(model["emit"][j][f][v] for f, v in enumerate(x)) for j in range(k)])
                            row = np.exp(logs - logs.max()) if s is None else np.eye(k)[s]
                        held[code], seen[code] = row, np.zeros(k)
                    at.append(held[code])
                if not at:
                    continue
                if model is None:
                    for code, row in zip(codes, at):
                        seen[code] += row
                    for before, after in zip(at, at[1:]):
                        steps += np.outer(before, after)
                    continue
                forward = [at[0] / at[0].sum()]
                for row in at[1:]:
                    v = forward[-1] @ moves * row
                    forward.append(v / v.sum())
                back = np.ones(k)
                for i in range(len(at) - 1, -1, -1):
                    both = forward[i] * back
                    seen[codes[i]] += both / both.sum()
                    if i:
                        ahead = at[i] * back
                        pairs = forward[i - 1][:, None] * moves * ahead[None, :]
                        steps += pairs / pairs.sum()
                        back = moves @ ahead
                        back /= back.sum()
        counts: Counter = Counter()
        for code, row in seen.items():
            for f, v in enumerate(_values(code)):
                for s in range(k):
                    counts["emit", s, f, v] += float(row[s])
        rows = [(*key, n) for key, n in counts.items()] + [("step", a, b, 0, float(steps[a, b])) for a in range(k) for b in range(k)]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n"])

    return run


def _model_of(rows: list) -> dict:
    """Log-probabilities from counts.  One count is added to each, two tenths of all steps
    stay in the state, so that states seen nowhere in the sample keep a chance."""
    emit = {(r["a"], r["b"], r["c"]): r["n"] for r in rows if r["kind"] == "emit"}
    step = {(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == "step"}
    k = range(len(STATES))
    log_emit = [[[0.0] * n for n in VALUES] for _ in k]
    for s in k:
        for f, n in enumerate(VALUES):
            total = sum(emit.get((s, f, v), 0) for v in range(n)) + n
            for v in range(n):
                log_emit[s][f][v] = math.log((emit.get((s, f, v), 0) + 1) / total)
    log_step = [[0.0] * len(STATES) for _ in k]
    for a in k:
        total = sum(step.get((a, b), 0) for b in k) + 1
        for b in k:
            p = (step.get((a, b), 0) + 0.25) / total
            log_step[a][b] = math.log(0.8 * p + 0.2 * (a == b))
    return {"emit": log_emit, "step": log_step}


def fit(documents: DataFrame, sample: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> dict:
    """The hidden Markov model, estimated by expectation and maximisation on the units of
    at most ``sample`` documents (those with the least hash of their id).  The units that
    leave no doubt give the first estimate; then, each round, every unit counts for each
    state as much as it is expected to be in it, given the whole document.  Only the
    counts per state and value reach the driver."""
    some = documents.where("text is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = cut(some.select("text").mapInPandas(_observed, "codes array<int>"))
    model = None
    for _ in range(rounds + 1):
        model = _model_of(seen.mapInPandas(_expected(model), _COUNTS).groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect())
    return model


def viterbi(observed: list[tuple[int, ...]], model: dict) -> list[int]:
    """The likeliest states; of equal ones the first."""
    if not observed:
        return []
    emit, known = model["emit"], model.setdefault("known", {})
    into = list(zip(*model["step"]))  # per state: from each state
    k = range(len(STATES))
    score, back = (0.0,) * len(STATES), []
    for i, x in enumerate(observed):
        at = known.get(x)
        if at is None:
            at = known[x] = tuple(sum(emit[s][f][v] for f, v in enumerate(x)) for s in k)
        if i == 0:
            score = at
            continue
        a, b, c, d = score
        now, come = [], []
        for s in k:
            t = into[s]
            best, p = a + t[0], 0
            if (v := b + t[1]) > best:
                best, p = v, 1
            if (v := c + t[2]) > best:
                best, p = v, 2
            if (v := d + t[3]) > best:
                best, p = v, 3
            now.append(best + at[s])
            come.append(p)
        score = now
        back.append(come)
    path = [max(k, key=lambda s: score[s])]
    for come in reversed(back):
        path.append(come[path[-1]])
    return path[::-1]


def non_prose_share(text: str, model: dict) -> tuple[float, list[int]]:
    """Share of the words in units that are no prose, and words per state."""
    seen = features(units(text))
    words = [0] * len(STATES)
    for (n, _), s in zip(seen, viterbi([x for _, x in seen], model)):
        words[s] += n
    total = sum(words)
    return ((total - words[0]) / total if total else 0.0), words


def page_kinds(documents: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, words, share, kind of every document: its words, the share of those that
    are no prose, and the commonest state.

    A hidden Markov model labels the lines of a page as prose, link list, tag list
    (keywords in a row included) or menu (keyword or product lines).  What a line shows
    (links, repetition, separators, sentence end and so on) uses no vocabulary, so all
    languages are alike.  Code in fences counts for nothing.  The whole text is read.
    Null or empty texts: share 0, kind ``prose``.  Rows without doc_id are no documents;
    a document that is there twice gives its largest share once.
    """
    model = model or fit(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [non_prose_share(t or "", model) for t in b["text"]]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "words": [sum(w) for _, w in got], "share": [s for s, _ in got], "kind": [STATES[max(range(4), key=lambda s: w[s])] for _, w in got]}
            )

    rows = for_every_core(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    found = rows.mapInPandas(run, "doc_id bigint, words bigint, share double, kind string")
    return found.groupBy("doc_id").agg(F.max(F.struct("share", "words", "kind")).alias("m")).select("doc_id", "m.words", "m.share", "m.kind")


def stuffed_pages(documents: DataFrame, model: dict | None = None, share: float = NON_PROSE) -> DataFrame:
    """doc_id of the documents more than half of whose words are no prose."""
    return page_kinds(documents, model).where(F.col("share") > share).select("doc_id")
