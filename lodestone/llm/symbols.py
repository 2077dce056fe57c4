"""Functions and methods of one lexed source file, with their documentation.

Only token kinds and brackets are looked at, so the file should have passed the
grammar first.  Constructors, functions inside functions and anything inside
comments or strings give no symbol.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from .languages import JS_SOFT, Lexed

_LETTERS = re.compile(r"[^\W\d_]+")
_NAME_WORDS = re.compile(r"[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])|[A-Z][^\W\d_A-Z]*")


@dataclass
class Symbol:
    type_name: str
    method_name: str
    #: parameter kinds with names, blanks and defaults left out: the overload's key
    signature: str
    start: int
    end: int
    doc: str | None
    #: false for what is only declared (no body, or a Python body that does nothing)
    has_body: bool
    #: types that the owner extends or implements, as they are written
    supers: tuple[str, ...] = ()
    #: false for the members of a TypeScript interface: they say what a method does, but
    #: are none themselves
    listed: bool = True


def name_words(*names: str) -> set[str]:
    return {w.lower() for n in names for w in _NAME_WORDS.findall(n)}


def useful_words(doc: str, type_name: str, method_name: str) -> int:
    """Words left after tag lines and the words of the names are dropped."""
    drop = name_words(type_name, method_name)
    lines = [x for x in doc.split("\n") if not x.strip().startswith(("@", ":"))]
    return sum(w.lower() not in drop for x in lines for w in _LETTERS.findall(x))


def comment_text(raw: str) -> str:
    """A comment without its marks."""
    if raw.startswith("//"):
        return "\n".join(re.sub(r"^\s*//+ ?", "", x) for x in raw.split("\n"))
    body = re.sub(r"^/\*+|\*+/$", "", raw)
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x).rstrip() for x in body.split("\n")).strip("\n")


def _brackets(t: Lexed) -> dict[int, int]:
    close, out, stack = {"(": ")", "[": "]", "{": "}"}, {}, []
    for i, k in enumerate(t.kinds):
        if k in close:
            stack.append(i)
        elif k in (")", "]", "}") and stack:
            out[stack.pop()] = i
    return out


# ---------------------------------------------------------------- Python
def _python_doc(t: Lexed, i: int) -> str | None:
    """The string that is the first statement from token i on, if one is."""
    j = i
    while t.kinds[j] == "STR":
        j += 1
    if j == i or t.kinds[j] not in ("NEWLINE", ";"):
        return None
    try:
        v = ast.literal_eval("(" + " ".join(t.words[i:j]) + ")")
    except (ValueError, SyntaxError, MemoryError):  # f-strings
        return None
    return v if isinstance(v, str) else None


def _does_nothing(t: Lexed, i: int) -> bool:
    """Whether the body that begins at token i only documents: a string, then pass, an
    ellipsis, a NotImplementedError or nothing."""
    kinds, n = t.kinds, len(t.kinds)
    while i < n and kinds[i] in ("STR", "NEWLINE", ";"):
        i += 1
    if i < n and kinds[i] == "DEDENT":
        return True
    e = i
    while e < n and kinds[e] not in ("NEWLINE", "EOF"):
        e += 1
    nothing = kinds[i:e] in (["pass"], ["..."]) or kinds[i:e][:1] == ["raise"] and t.words[i + 1] == "NotImplementedError"
    return nothing and (e + 1 >= n or kinds[e + 1] in ("DEDENT", "EOF") or kinds[i - 1] not in ("INDENT", "NEWLINE"))


def _type_names(t: Lexed, a: int, b: int) -> tuple[str, ...]:
    """Names of the types between two tokens, the last part of each, arguments left out."""
    out: list[str] = []
    depth = 0
    for i in range(a, b):
        k = t.kinds[i]
        depth += (k in ("<", "[")) - (k in ("GT", "GTA", "]"))
        if depth == 0 and (k == "NAME" or k in JS_SOFT) and t.kinds[i + 1] not in (".", "="):
            out.append(t.words[i])
    return tuple(dict.fromkeys(out))


def python_symbols(t: Lexed) -> list[Symbol]:
    out, kinds, n = [], t.kinds, len(t.kinds)
    pairs = _brackets(t)
    depth, i = 0, 0
    scopes: list[tuple[str, str, int]] = []  # kind, name, depth of its body
    bases: dict[str, tuple[str, ...]] = {}
    open_symbols: list[tuple[int, Symbol]] = []
    while i < n:
        k = kinds[i]
        if k == "INDENT":
            depth += 1
        elif k == "DEDENT":
            depth -= 1
            while scopes and scopes[-1][2] > depth:
                scopes.pop()
            while open_symbols and open_symbols[-1][0] > depth:
                open_symbols.pop()[1].end = t.end[i - 1] if kinds[i - 1] != "DEDENT" else t.start[i]
        elif k in ("def", "class") and i + 1 < n:
            at = t.start[i]
            name = t.words[i + 1]
            j, signature = i + 2, ""
            while j < n and kinds[j] != ":":
                if j in pairs:
                    if kinds[j] == "(" and not signature:
                        signature = _parameters(t, j, pairs[j], pairs)
                    j = pairs[j]
                j += 1
            block = j + 1 < n and kinds[j + 1] == "NEWLINE"
            body = j + 3 if block else j + 1
            if k == "class":
                bases[name] = _type_names(t, i + 2, j)
            if k == "def":
                inside = any(s == "def" for s, _, _ in scopes)
                owner = scopes[-1][1] if scopes else ""
                if not inside and name not in ("__init__", "__new__"):
                    s = Symbol(owner, name, signature, at, t.end[min(body, n - 1)], _python_doc(t, body) if body < n else None, body >= n or not _does_nothing(t, body), bases.get(owner, ()))
                    out.append(s)
                    if block:
                        open_symbols.append((depth + 1, s))
            if block:
                scopes.append((k, name, depth + 1))
            i = j
            continue
        i += 1
    return out


def _parameters(t: Lexed, a: int, b: int, pairs: dict[int, int]) -> str:
    """Types of the parameters between two brackets; `_` where none is given."""
    parts, part, i = [], [], a + 1
    while i <= b:
        if i == b or t.kinds[i] == ",":
            if part:
                kinds = [w for w in part]
                if ":" in kinds:
                    kinds = kinds[kinds.index(":") + 1 :]
                    kinds = kinds[: kinds.index("=")] if "=" in kinds else kinds
                elif len(kinds) > 1 and kinds[-1] not in (")", "]", "}"):
                    kinds = kinds[:-1] if not kinds[0] in ("*", "**") else kinds[:1]
                else:
                    kinds = ["_"]
                parts.append("".join(kinds))
            part = []
            i += 1
            continue
        e = pairs.get(i, i)
        part += t.words[i : e + 1]
        i = e + 1
    return ",".join(parts)


# ---------------------------------------------------------------- comments before declarations
class _Before:
    """The comment that stands directly before a token."""

    def __init__(self, t: Lexed):
        self.t = t
        self.by_end = sorted(t.comments, key=lambda c: c[1])
        self.ends = [c[1] for c in self.by_end]

    def doc(self, at: int, low: int, block_only: bool) -> str | None:
        from bisect import bisect_right

        text = self.t.text
        k = bisect_right(self.ends, at) - 1
        if k < 0 or self.by_end[k][0] < low:
            return None
        a, b = self.by_end[k]
        if text[b:at].strip():
            return None
        raw = text[a:b]
        if block_only:
            return comment_text(raw) if raw.startswith("/**") and len(raw) > 4 else None
        if text[b:at].count("\n") > 1:
            return None
        parts = [raw]
        while raw.startswith("//") and k > 0:  # lines of one comment
            k -= 1
            p, q = self.by_end[k]
            if p < low or text[q:a] .strip() or text[q:a].count("\n") > 1 or not text.startswith("//", p):
                break
            parts.insert(0, text[p:q])
            a = p
        return "\n".join(comment_text(x) for x in parts)


def _skip_decorators(t: Lexed, i: int, pairs: dict[int, int]) -> int:
    while t.kinds[i] == "@" and t.kinds[i + 1] != "interface":
        i += 2
        while t.kinds[i] == ".":
            i += 2
        if t.kinds[i] == "(":
            i = pairs[i] + 1
    return i


# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_MODS = {"static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor", "async", "get", "set", "*"}


def js_symbols(t: Lexed) -> list[Symbol]:
    pairs, before = _brackets(t), _Before(t)
    out: list[Symbol] = []
    kinds, words, n = t.kinds, t.words, len(t.kinds)

    def doc(first: int, after: int) -> str | None:
        """first: the declaration's first token, after: its first after decorators."""
        low = t.end[first - 1] if first else 0
        got = before.doc(t.start[first], low, True)
        return got if got is not None or after == first else before.doc(t.start[after], t.end[after - 1], True)

    def after_signature(i: int) -> tuple[int, str]:
        """i: '<' or '('; gives the token after the result type and the parameter types."""
        while i < n and kinds[i] != "(":
            i += 1
        if i >= n:
            return n, ""
        signature = _parameters(t, i, pairs[i], pairs)
        i = pairs[i] + 1
        if i < n and kinds[i] == ":":
            i += 1
            while i < n and kinds[i] not in ("{", ";", "=>", "EOF") or kinds[i] == "{" and kinds[i - 1] in (":", "|", "&", "=>"):
                i = pairs[i] + 1 if i in pairs else i + 1
        return i, signature

    def members(a: int, b: int, owner: str, supers: tuple[str, ...], listed: bool = True) -> None:
        i = a
        while i < b:
            if kinds[i] == ";" or not listed and kinds[i] == ",":
                i += 1
                continue
            first = i
            i = j = _skip_decorators(t, i, pairs)
            while i < b and words[i] in _JS_MODS and (words[i] == "*" or kinds[i + 1] not in ("(", "=", ";", ":", "?", "!", "<", "}")):
                i += 1
            if kinds[i] == "{":  # static block
                i = pairs[i] + 1
                continue
            name_at = i
            i = pairs[i] + 1 if i in pairs else i + 1
            if kinds[i] in ("?", "!"):
                i += 1
            if kinds[i] in ("(", "<"):
                e, signature = after_signature(i)
                body = kinds[e] == "{"
                end = pairs[e] if body else e
                if words[name_at] != "constructor" and kinds[name_at] != "[":
                    out.append(Symbol(owner, words[name_at].strip("\"'"), signature, t.start[first], t.end[min(end, n - 1)], doc(first, j), body, supers, listed))
                i = end + 1
                continue
            while i < b and kinds[i] != ";" and (listed or kinds[i] != ","):
                if t.nl[i] and kinds[i - 1] not in ("=", "=>", ",", ":", "|", "&", "+", "?") and kinds[i] not in ("=", ".", "?", ":", "+", "|", "&"):
                    break
                i = pairs[i] + 1 if i in pairs else i + 1

    def block(i: int, b: int) -> None:
        start = True  # whether a statement may begin here
        first = i
        while i < b:
            k = kinds[i]
            if start:
                first = i
                i = j = _skip_decorators(t, i, pairs)
                while kinds[i] in ("export", "default", "declare", "abstract") and kinds[i + 1] not in ("(", "=", "."):
                    i += 1
                k = kinds[i]
                if k == "class" or k == "interface":
                    name = words[i + 1] if kinds[i + 1] == "NAME" or kinds[i + 1] in JS_SOFT else ""
                    head = i + 1 + bool(name)
                    while i < b and kinds[i] != "{":
                        i = pairs[i] + 1 if i in pairs else i + 1
                    if i < b:
                        members(i + 1, pairs[i], name, tuple(x for x in _type_names(t, head, i)), k == "class")
                    i = pairs.get(i, i) + 1
                    continue
                f = i + 1 if k == "async" and kinds[i + 1] == "function" else i
                if kinds[f] == "function":
                    g = f + 1 + (kinds[f + 1] == "*")
                    name = words[g] if kinds[g] != "(" else ""
                    e, signature = after_signature(g)
                    body = e < n and kinds[e] == "{"
                    end = pairs[e] if body else min(e, n - 1)
                    if name:
                        out.append(Symbol("", name, signature, t.start[first], t.end[end], doc(first, j), body))
                    i = end + 1
                    continue
                if k == "const" and (kinds[i + 1] == "NAME" or kinds[i + 1] in JS_SOFT):
                    e = i + 2
                    while e < b and kinds[e] not in ("=", ";", ","):
                        e = pairs[e] + 1 if e in pairs else e + 1
                    if e < b and kinds[e] == "=":
                        v = e + 1 + (kinds[e + 1] == "async" and kinds[e + 2] != "=>")
                        got = None
                        if kinds[v] == "function":
                            got, signature = after_signature(v)
                        elif kinds[v] in ("(", "<"):
                            x, signature = after_signature(v)
                            got = x + 1 if x < n and kinds[x] == "=>" else None
                        elif kinds[v + 1] == "=>":
                            got, signature = v + 2, "_"
                        if got is not None and got < n:
                            end = pairs.get(got, got)
                            out.append(Symbol("", words[i + 1], signature, t.start[first], t.end[end], doc(first, j), True))
                            i = end + 1
                            start = False
                            continue
                if k in ("namespace", "module") and not t.nl[i + 1] and kinds[i + 1] in ("NAME", "STR"):
                    while i < b and kinds[i] not in ("{", ";"):
                        i += 1
                    if i < b and kinds[i] == "{":
                        block(i + 1, pairs[i])
                        i = pairs[i] + 1
                    continue
            nxt = pairs[i] + 1 if i in pairs else i + 1
            start = kinds[nxt - 1] in (";", "}") or nxt < n and t.nl[nxt]
            i = nxt

    block(0, n - 1)
    return out


# ---------------------------------------------------------------- Java
_JAVA_MODS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}


def java_symbols(t: Lexed) -> list[Symbol]:
    pairs, before = _brackets(t), _Before(t)
    out: list[Symbol] = []
    kinds, words, n = t.kinds, t.words, len(t.kinds)

    def doc(first: int, later: list[int]) -> str | None:
        low = t.end[first - 1] if first else 0
        got = before.doc(t.start[first], low, True)
        for x in later:
            if got is None:
                got = before.doc(t.start[x], t.end[x - 1], True)
        return got

    def angle(i: int) -> int:
        depth = 0
        while i < n:
            depth += (kinds[i] == "<") - (kinds[i] in ("GT", "GTA"))
            i += 1
            if depth == 0:
                break
        return i

    def body(a: int, b: int, owner: str, supers: tuple[str, ...] = ()) -> None:
        i = a
        while i < b:
            if kinds[i] in (";", ","):
                i += 1
                continue
            first, later = i, []
            while True:
                j = _skip_decorators(t, i, pairs)
                if j != i:
                    later.append(j)
                i = j
                if kinds[i] in _JAVA_MODS:
                    i += 1
                elif words[i] == "non" and kinds[i + 1] == "-":
                    i += 3
                else:
                    break
            if kinds[i] == "{":
                i = pairs[i] + 1
                continue
            is_type = kinds[i] in ("class", "interface", "enum") or kinds[i] == "@" or words[i] == "record" and kinds[i + 1] == "NAME" and kinds[i + 2] in ("(", "<")
            if is_type:
                i += 1 + (kinds[i] == "@")
                name = words[i]
                is_enum = kinds[i - 1] == "enum"
                head = i + 1
                while i < b and kinds[i] != "{":
                    i = pairs[i] + 1 if kinds[i] == "(" else i + 1
                if i >= b:
                    return
                inner = i + 1
                if is_enum:  # the constants end at the semicolon
                    while inner < pairs[i] and kinds[inner] != ";":
                        inner = pairs[inner] + 1 if inner in pairs else inner + 1
                body(inner, pairs[i], name, _type_names(t, head, i))
                i = pairs[i] + 1
                continue
            if kinds[i] == "<":
                i = angle(i)
            begin = i
            while i < b and kinds[i] not in ("(", "=", ";", "{"):
                i = angle(i) if kinds[i] == "<" else pairs[i] + 1 if i in pairs else i + 1
            if i < b and kinds[i] == "(" and i - 1 > begin:
                signature = _parameters(t, i, pairs[i], pairs)
                name = words[i - 1]
                e = pairs[i] + 1
                while e < b and kinds[e] not in ("{", ";"):
                    e = pairs[e] + 1 if e in pairs else e + 1
                has = e < b and kinds[e] == "{"
                end = pairs[e] if has else e
                out.append(Symbol(owner, name, signature, t.start[first], t.end[min(end, n - 1)], doc(first, later), has, supers))
                i = end + 1
            elif i < b and kinds[i] in ("(", "{"):  # constructor
                while i < b and kinds[i] not in ("{", ";"):
                    i = pairs[i] + 1 if i in pairs else i + 1
                i = pairs.get(i, i) + 1
            else:
                while i < b and kinds[i] != ";":
                    i = pairs[i] + 1 if i in pairs else i + 1
                i += 1

    i = 0
    while i < n and kinds[i] in ("package", "import", ";", "@"):
        if kinds[i] == "@":
            j = _skip_decorators(t, i, pairs)
            if kinds[j] != "package":
                break
            i = j
        while i < n and kinds[i] != ";":
            i += 1
        i += 1
    body(i, n - 1, "")
    return out


# ---------------------------------------------------------------- Go
def go_symbols(t: Lexed) -> list[Symbol]:
    pairs, before = _brackets(t), _Before(t)
    out: list[Symbol] = []
    kinds, words, n, i = t.kinds, t.words, len(t.kinds), 0
    while i < n:
        if kinds[i] == "func" and (i == 0 or kinds[i - 1] == ";"):
            first, owner = i, ""
            i += 1
            if kinds[i] == "(":
                names = [words[x] for x in range(i + 1, pairs[i]) if kinds[x] == "NAME"]
                generic = [x for x in range(i + 1, pairs[i]) if kinds[x] == "["]
                if generic:
                    names = [words[x] for x in range(i + 1, generic[0]) if kinds[x] == "NAME"]
                owner = names[-1] if names else ""
                i = pairs[i] + 1
            name = words[i]
            i += 1
            if kinds[i] == "[":
                i = pairs[i] + 1
            signature = _parameters(t, i, pairs[i], pairs) if kinds[i] == "(" else ""
            i = pairs.get(i, i) + 1
            while i < n and kinds[i] not in ("{", ";"):
                i = pairs[i] + 1 if i in pairs else i + 1 + (kinds[i] in ("interface", "struct") and i + 1 in pairs and pairs[i + 1] - i)
            has = i < n and kinds[i] == "{"
            end = pairs[i] if has else min(i, n - 1)
            low = t.end[first - 1] if first else 0
            out.append(Symbol(owner, name, signature, t.start[first], t.end[end], before.doc(t.start[first], low, False), has))
            i = end + 1
            continue
        i = pairs[i] + 1 if i in pairs else i + 1
    return out


SYMBOLS = {"python": python_symbols, "javascript": js_symbols, "typescript": js_symbols, "java": java_symbols, "go": go_symbols}
