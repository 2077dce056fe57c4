"""Generalised LL recogniser with a graph-structured stack.

A grammar is written as text in an EBNF and compiled into a flat program of a
few instructions (match, call, fork, jump, test, end).  The recogniser runs
that program over token numbers:

* a stack node stands for one nonterminal called at one position; every caller
  is an edge of it, so that all parses which call the same thing at the same
  place share the work (left recursion and ambiguity included);
* forks take every branch whose FIRST/FOLLOW set admits the next token, hence
  deterministic stretches cost no more than recursive descent;
* several start symbols may run over one stack, which is how the grammars of
  several dialects are tried together: a text is rejected only if all fail;
* nonterminals marked ``@`` open and close with a bracket.  Their span is known
  before parsing, so the verdict on (nonterminal, token kinds in the span) is
  kept and used again wherever the same shape turns up, in this text or later.
"""

from __future__ import annotations

import re
from array import array

from xxhash import xxh3_128_intdigest

MATCH, CALL, FORK, JUMP, TEST, END, ISLAND = range(7)
EOF = "EOF"


class Grammar:
    """Compiled form of a grammar text.

    Lines are ``Name = rhs`` (``Name@ = rhs`` for bracketed ones) and
    ``$Class = 'a' B 'c'`` for sets of terminals.  In a right-hand side quoted
    words and ALL-CAPS names are terminals, ``%word`` is a zero-width test.
    """

    def __init__(self, dialects: dict[str, str], tests=None):
        """dialects: grammar texts by a prefix for their nonterminals; tests: makes
        the zero-width tests from the table of token numbers."""
        self.ids: dict[str, int] = {"EOF": 1, "ERR": 2}
        self.tests = tests(self.tid) if tests else {}
        self.islands: set[str] = set()
        rules: dict[str, list[str]] = {}
        for prefix, text in dialects.items():
            self._read(prefix, text, rules)
        self.nts = {n: k for k, n in enumerate(rules)}
        self.code: list[tuple] = []
        self.entry: list[int] = []
        self.owner: list[int] = []
        for name, toks in rules.items():
            self.entry.append(len(self.code))
            rest = self._alt(toks)
            assert not rest, (name, rest)
            self.code.append((END, None))
            self.owner += [self.nts[name]] * (len(self.code) - len(self.owner))
        self._lookahead()

    def _read(self, prefix: str, text: str, rules: dict[str, list[str]]) -> None:
        own: dict[str, list[str]] = {}
        self.classes: dict[str, frozenset[int]] = {}
        for line in re.sub(r"\n[ \t]+", " ", text).splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            head, rhs = (x.strip() for x in line.split("=", 1))
            if head[0] == "$":
                got: set[int] = set()
                for w in rhs.split():
                    got |= self.classes[w] if w[0] == "$" else {self.tid(w.strip("'"))}
                self.classes[head] = frozenset(got)
                continue
            if head.endswith("@"):
                head = head[:-1]
                self.islands.add(head)
            toks = re.findall(r"'[^'\s]+'|[$%]?\w+|[()|*+?]", rhs)
            toks = [self.classes[t] if t[0] == "$" else t for t in toks]
            own[head] = own[head] + ["|"] + toks if head in own else toks
        for head, toks in own.items():
            if prefix and head in self.islands:
                self.islands.add(prefix + head)
            rules[prefix + head] = [prefix + t if prefix and isinstance(t, str) and t in own else t for t in toks]

    def tid(self, word: str) -> int:
        return self.ids.setdefault(word, len(self.ids) + 1)

    # -- text to instructions ------------------------------------------------
    def _alt(self, toks: list[str]) -> list[str]:
        at = len(self.code)
        branches = []
        while True:
            begin = len(self.code)
            toks = self._seq(toks)
            branches.append((begin, len(self.code)))
            if toks and toks[0] == "|":
                toks = toks[1:]
                self.code.append((JUMP, None))
                continue
            break
        if len(branches) > 1:
            self._insert(at, (FORK, [b + 1 for b, _ in branches]))
            end = len(self.code)
            for _, e in branches[:-1]:
                self.code[e + 1] = (JUMP, end)
        return toks

    def _insert(self, at: int, ins: tuple) -> None:
        """Puts an instruction before those from ``at`` on and moves their targets."""
        for k in range(at, len(self.code)):
            op, x = self.code[k]
            if op == FORK:
                self.code[k] = (op, [t + (t >= at) for t in x])
            elif op == JUMP and x is not None:
                self.code[k] = (op, x + (x >= at))
        self.code.insert(at, ins)

    def _seq(self, toks: list[str]) -> list[str]:
        while toks and toks[0] not in (")", "|"):
            at = len(self.code)
            t, toks = toks[0], toks[1:]
            if isinstance(t, frozenset):
                self.code.append((MATCH, t))
            elif t == "(":
                toks = self._alt(toks)
                assert toks[0] == ")", toks
                toks = toks[1:]
            elif t[0] == "'":
                self.code.append((MATCH, frozenset([self.tid(t[1:-1])])))
            elif t[0] == "%":
                self.code.append((TEST, self.tests[t[1:]]))
            elif t in self.nts:
                self.code.append((ISLAND if t in self.islands else CALL, self.nts[t]))
            else:
                assert t.isupper(), t
                self.code.append((MATCH, frozenset([self.tid(t)])))
            if toks and toks[0] in ("*", "+", "?"):
                q, toks = toks[0], toks[1:]
                if q == "+":
                    self.code.append((FORK, [at, len(self.code) + 1]))
                else:
                    self._insert(at, (FORK, [at + 1, len(self.code) + 1 + (q == "*")]))
                    if q == "*":
                        self.code.append((JUMP, at))
        return toks

    # -- which tokens may come next -------------------------------------------
    def _lookahead(self) -> None:
        n = len(self.code)
        first = [frozenset()] * n
        empty = [op == END for op, _ in self.code]
        changed = True
        while changed:
            changed = False
            for k in range(n - 1, -1, -1):
                op, x = self.code[k]
                f, e = first[k], empty[k]
                if op == MATCH:
                    f = x
                elif op in (CALL, ISLAND):
                    s = self.entry[x]
                    f = first[s] | (first[k + 1] if empty[s] else frozenset())
                    e = empty[s] and empty[k + 1]
                elif op == FORK:
                    f = frozenset().union(*(first[t] for t in x))
                    e = any(empty[t] for t in x)
                elif op == JUMP:
                    f, e = first[x], empty[x]
                elif op == TEST:
                    f, e = first[k + 1], empty[k + 1]
                if f != first[k] or e != empty[k]:
                    first[k], empty[k], changed = f, e, True
        follow = [frozenset()] * len(self.entry)
        changed = True
        while changed:
            changed = False
            for k, (op, x) in enumerate(self.code):
                if op in (CALL, ISLAND):
                    f = follow[x] | first[k + 1] | (follow[self.owner[k]] if empty[k + 1] else frozenset())
                    if f != follow[x]:
                        follow[x], changed = f, True
        look = [first[k] | (follow[self.owner[k]] if empty[k] else frozenset()) for k in range(n)]
        tokens = len(self.ids) + 1
        for k, (op, x) in enumerate(self.code):
            if op == FORK:
                self.code[k] = (FORK, [tuple(t for t in x if c in look[t]) for c in range(tokens)])
        self.look = [look[s] for s in self.entry]
        self.ops = [op for op, _ in self.code]
        self.args = [x for _, x in self.code]


class Tokens:
    """Token numbers of one text; ``nl[i]``: a line end stands before token i.

    ``fingerprint(i, j)`` is 128 bits of the kinds and line ends of tokens i to j - 1,
    under which their verdicts are kept: an entry of the memo has one size, however
    long the run is.  ``notes`` is where tests keep what they found.
    """

    __slots__ = ("kinds", "nl", "match", "notes", "_opening", "_coded")

    def __init__(self, kinds: list[int], nl: list[bool], opens: dict[int, int]):
        self.kinds, self.nl = kinds, nl
        self._coded = memoryview(array("H", [2 * k + b for k, b in zip(kinds, nl)])).cast("B")
        self.notes: dict = {}
        self._opening: dict[int, int] | None = None
        self.match: dict[int, int] = {}
        stack: list[tuple[int, int]] = []
        closers = set(opens.values())
        for i, k in enumerate(kinds):
            if k in opens:
                stack.append((opens[k], i))
            elif k in closers:
                if not stack or stack[-1][0] != k:
                    break  # what follows is parsed without islands
                self.match[stack.pop()[1]] = i

    def opening(self, i: int) -> int | None:
        """The bracket that the one at i closes."""
        if self._opening is None:
            self._opening = {b: a for a, b in self.match.items()}
        return self._opening.get(i)

    def fingerprint(self, i: int, j: int) -> int:
        return xxh3_128_intdigest(self._coded[2 * i : 2 * j])


#: Entries of the memo, of about 200 bytes each.
MEMO_LIMIT = 300_000
_memo: dict[tuple, bool] = {}


def _keep(key: tuple, verdict: bool) -> bool:
    if len(_memo) >= MEMO_LIMIT:
        _memo.clear()
    _memo[key] = verdict
    return verdict


def accepts(g: Grammar, t: Tokens, starts: list[str]) -> bool:
    """Whether one of the start symbols derives all tokens (the last is EOF)."""
    k = (id(g), *starts, len(t.kinds), t.fingerprint(0, len(t.kinds)))
    if (got := _memo.get(k)) is None:
        try:
            got = _run(g, t, [g.nts[s] for s in starts], 0, len(t.kinds), True)
        except RecursionError:  # brackets nested too deep for islands
            got = _run(g, t, [g.nts[s] for s in starts], 0, len(t.kinds), False)
        _keep(k, got)
    return got


def _run(g: Grammar, t: Tokens, starts: list[int], begin: int, goal: int, islands: bool) -> bool:
    ops, args, entry, look = g.ops, g.args, g.entry, g.look
    kinds, match = t.kinds, t.match
    n = len(kinds)
    # node: [edges, popped positions]; an edge is (return address, node of the caller)
    nodes: dict[tuple[int, int], list] = {}
    root: list = [[], set()]
    seen: set[tuple] = set()
    todo: list[tuple] = []
    for s in starts:
        todo.append((entry[s], root, begin))
    while todo:
        at, node, i = todo.pop()
        while True:
            op, x = ops[at], args[at]
            if op == MATCH:
                if i >= n or kinds[i] not in x:
                    break
                i += 1
                at += 1
            elif op == JUMP:
                at = x
            elif op == FORK:
                ways = x[kinds[i]] if i < n else ()
                if not ways:
                    break
                mark = (at, id(node), i)
                if mark in seen:
                    break
                seen.add(mark)
                for w in ways[1:]:
                    todo.append((w, node, i))
                at = ways[0]
            elif op == TEST:
                if not x(t, i):
                    break
                at += 1
            elif op == END:
                if node is root:
                    if i == goal:
                        return True
                    break
                edges, popped = node
                if i in popped:
                    break
                popped.add(i)
                if len(edges) > 1:
                    for back, up in edges[1:]:
                        todo.append((back, up, i))
                at, node = edges[0]
            else:
                if op == ISLAND and islands and (j := match.get(i)) is not None:
                    k = (id(g), x, j - i, t.fingerprint(i, j + 1))
                    if (got := _memo.get(k)) is None:
                        got = _keep(k, _run(g, t, [x], i, j + 1, True))
                    if not got:
                        break
                    i = j + 1
                    at += 1
                    continue
                if i >= n or kinds[i] not in look[x]:
                    break
                callee = nodes.get((x, i))
                if callee is not None:
                    edge = (at + 1, node)
                    if any(a == at + 1 and u is node for a, u in callee[0]):
                        break
                    callee[0].append(edge)
                    for j in callee[1]:
                        todo.append((at + 1, node, j))
                    break
                nodes[(x, i)] = callee = [[(at + 1, node)], set()]
                at, node = entry[x], callee
    return False


def expand(text: str, on: str = "") -> str:
    """Grammar text with ``<<word ...>>`` kept only where word is in ``on``.  A rule
    that holds ``§`` is written twice: without it (keeping ``<<P ...>>``) and with F
    in its place (keeping ``<<F ...>>``)."""

    def keep(line: str, words: set[str]) -> str:
        return re.sub(r"<<(\w+) (.*?)>>", lambda m: m[2] if m[1] in words else "", line)

    names, out = set(on.split()), []
    for line in re.sub(r"\n[ \t]+", " ", text).splitlines():
        if "§" in line:
            out += [keep(line, names | {"P"}).replace("§", ""), keep(line, names | {"F"}).replace("§", "F")]
        else:
            out.append(keep(line, names))
    return "\n".join(out)
