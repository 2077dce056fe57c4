"""Lexers and dialect grammars of Python, JavaScript, TypeScript, Java and Go.

Expression grammars leave out operator precedence where only validity counts.
Texts are lexed after one leading byte order mark is dropped and every line end
is written as a line feed.  A character no token can begin with, a string that
does not end, a number run into a name and the like become an ERR token, which
no grammar accepts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from .gll import Grammar, Tokens, accepts, expand


@dataclass
class Lexed:
    """kinds[i]: kind of token i, at start[i]:end[i] (``words`` has the texts); nl[i]: a
    line end stands before it; comments: spans."""

    text: str
    kinds: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    nl: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, a: int, b: int, nl: bool) -> None:
        self.kinds.append(kind)
        self.start.append(a)
        self.end.append(b)
        self.nl.append(nl)

    @cached_property
    def words(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start, self.end)]


def normalise(content: str) -> str:
    if content.startswith("﻿"):
        content = content[1:]
    return content.replace("\r\n", "\n").replace("\r", "\n")


def _ops(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


# ---------------------------------------------------------------- Python
PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
PY_SOFT = frozenset({"match", "case", "type"})
_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\n)|(?P<nl>\n)|(?P<com>\#[^\n]*)
    |(?P<fs>(?i:[ft]|[ft]r|r[ft])(?:\"\"\"|'''|\"|'))
    |(?P<str>(?i:[rbu]|br|rb)?(?:\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''|\"(?!\"\")[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'(?!'')[^'\\\n]*(?:\\.[^'\\\n]*)*'))
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)(?!\.))(?![\w]))
    |(?P<id>[^\W\d]\w*)
    |(?P<op>"""
    + _ops("... ** // >> << <= >= == != -> := += -= *= /= %= &= |= ^= @= **= //= >>= <<= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =")
    + ")",
    re.X | re.S,
)
#: A number may stand directly before one of these words: 1if x else y
_PY_RUN = re.compile(r"(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?=(?:and|else|for|if|in|is|not|or)\b)")
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_KINDS = {w: w for w in PY_KEYWORDS | PY_SOFT}
#: What a string that is not raw may hold; looked at only where one of these escapes is.
_PY_ESCAPES = re.compile(r"\\[xuUN]")
_PY_TEXT = re.compile(r"[^\\]*(?:\\(?:[^xuUN]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}|N\{[^{}]+\})[^\\]*)*", re.S)
_PY_BYTES = re.compile(r"[^\\]*(?:\\(?:[^x]|x[0-9a-fA-F]{2})[^\\]*)*", re.S)
#: Text of a string with fields up to the next field or the end: by quote.
_PY_PARTS = {q: re.compile(rf"(?:[^\\{{}}{q[0]}{'' if len(q) == 3 else chr(92) + 'n'}]+|\\(?:N\{{[^{{}}]+\}}|[^{{}}])|\\(?=[{{}}])|\{{\{{|\}}\}}" + (rf"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + ")*", re.S) for q in ('"""', "\'\'\'", '"', "'")}
_PY_RAW_PARTS = {q: re.compile(rf"(?:[^\\{{}}{q[0]}{'' if len(q) == 3 else chr(92) + 'n'}]+|\\[^{{}}]|\\(?=[{{}}])|\{{\{{|\}}\}}" + (rf"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + ")*", re.S) for q in ('"""', "\'\'\'", '"', "'")}
#: The same in a format after a colon, where doubled braces are fields.
_PY_FORMATS = {q: re.compile(rf"[^{{}}{q[0]}\n]*" if len(q) == 1 else rf"(?:[^{{}}{q[0]}]|{q[0]}(?!{q[0] * 2}))*") for q in ('"""', "\'\'\'", '"', "'")}


def _python_text(word: str) -> str:
    """Kind of a string: STR, BYTES, or ERR where it holds an escape that is none."""
    q = min(k for k in (word.find("'"), word.find('"')) if k >= 0)
    prefix = word[:q].lower()
    if "b" in prefix:
        return "BYTES" if word.isascii() and ("r" in prefix or _PY_BYTES.fullmatch(word)) else "ERR"
    return "STR" if "r" in prefix or not _PY_ESCAPES.search(word) or _PY_TEXT.fullmatch(word) else "ERR"


def lex_python(content: str) -> Lexed:
    """Strings with fields become FS, the tokens of their fields between F{ and F}, and FE."""
    t = normalise(content)
    out, i, n, depth = Lexed(t), 0, len(t), 0
    indents, alts, line_start = [0], [0], True
    kinds, add, match = out.kinds, out.add, _PY.match
    fields: list[tuple[str, bool, int]] = []  # open strings with fields: quote, raw, depth outside
    inside = 0  # depth of the field we are in, 0 for none

    def literal(formats: bool) -> bool:
        """Reads text of the innermost open string from i on; false if it does not end."""
        nonlocal i, depth, inside
        quote, raw, outer = fields[-1]
        while True:
            i = (_PY_FORMATS if formats else _PY_RAW_PARTS if raw else _PY_PARTS)[quote].match(t, i).end()
            if i >= n:
                return False
            if t[i] == "{":
                depth += 1
                inside = depth
                add("F{", i, i + 1, False)
                i += 1
                return True
            if t[i] == "}":
                if not formats:
                    return False
                i = close(i)
                formats = bool(specs) and specs[-1] == depth  # a field within a format goes back to it
                continue
            if formats or not t.startswith(quote, i):
                return False
            add("FE", i, i + len(quote), False)
            i += len(quote)
            fields.pop()
            depth = outer
            inside = levels.pop()
            return True

    levels: list[int] = []
    specs: list[int] = []  # depths of the fields whose format we are in

    def close(at: int) -> int:
        nonlocal depth
        add("F}", at, at + 1, False)
        if specs and specs[-1] == depth:
            specs.pop()
        depth -= 1
        return at + 1

    while True:
        if line_start and depth == 0:
            m = _PY_INDENT.match(t, i)
            col = alt = 0
            w = m[0]
            if "\t" in w or "\f" in w:
                for ch in w:
                    if ch == " ":
                        col, alt = col + 1, alt + 1
                    elif ch == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    else:
                        col = alt = 0
            else:
                col = alt = len(w)
            j = m.end()
            if j < n and t[j] in "\n#":  # blank or comment line
                e = t.find("\n", j)
                e = n if e < 0 else e
                if t[j] == "#":
                    out.comments.append((j, e))
                i = e + 1
                if i >= n:
                    i, line_start = n, False
                continue
            if j >= n:
                i, line_start = n, False
                continue
            i, line_start = j, False
            if col == indents[-1]:
                if alt != alts[-1]:
                    add("ERR", i, i, False)
            elif col > indents[-1]:
                if alt <= alts[-1]:
                    add("ERR", i, i, False)
                indents.append(col)
                alts.append(alt)
                add("INDENT", i, i, False)
            else:
                while col < indents[-1]:
                    indents.pop()
                    alts.pop()
                    add("DEDENT", i, i, False)
                if col != indents[-1] or alt != alts[-1]:
                    add("ERR", i, i, False)
        if i >= n:
            break
        if inside and depth == inside:  # what ends the expression of a field
            c = t[i]
            if c == "}":
                i = close(i)
                inside = 0
                if not literal(bool(specs) and specs[-1] == depth):
                    add("ERR", i, n, False)
                    break
                continue
            if c == ":":
                add("F:", i, i + 1, False)
                i += 1
                specs.append(depth)
                inside = 0
                if not literal(True):
                    add("ERR", i, n, False)
                    break
                continue
            if c == "!" and not t.startswith("!=", i):
                m = _FIELD_FORM.match(t, i)
                add("F!" if m else "ERR", i, i + 1, False)
                i = m.end() if m else i + 1
                continue
            if c == "=" and not t.startswith("==", i) and _FIELD_ENDS.match(t, i + 1):
                add("F=", i, i + 1, False)
                i += 1
                continue
        m = match(t, i)
        if not m:
            m = _PY_RUN.match(t, i)
            if m:
                add("NUM", i, m.end(), False)
                i = m.end()
                continue
            add("ERR", i, i + 1, False)
            if t[i] in "\"'":  # a string that does not end: the rest is no code
                break
            i += 1
            continue
        kind, a, i = m.lastgroup, i, m.end()
        if kind == "id":
            add(_PY_KINDS.get(m[0], "NAME"), a, i, False)
        elif kind == "op":
            w = m[0]
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            add(w, a, i, False)
        elif kind == "nl":
            if depth == 0:
                add("NEWLINE", a, i, False)
                line_start = True
        elif kind == "com":
            out.comments.append((a, i))
        elif kind == "str":
            add(_python_text(m[0]), a, i, False)
        elif kind == "num":
            add("NUM", a, i, False)
        elif kind == "fs":
            w = m[0]
            quote = w.lstrip("rRfFtT")
            add("FS", a, i, False)
            fields.append((quote, "r" in w.lower(), depth))
            levels.append(inside)
            depth += 1
            inside = 0
            if not literal(False):
                add("ERR", i, n, False)
                break
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT") and depth == 0:
        add("NEWLINE", n, n, False)
    for _ in indents[1:]:
        add("DEDENT", n, n, False)
    add("EOF", n, n, False)
    return out


_FIELD_ENDS, _FIELD_FORM = re.compile(r"\s*[}!:]"), re.compile(r"![rsa](?=\s*[}:])")


PY_GRAMMAR = r"""
$Id = NAME 'match' 'case' 'type'
$Aug = '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '@=' '**=' '//=' '>>=' '<<='
$Ar = '+' '-' '*' '/' '%' '//' '@' '&' '|' '^' '<<' '>>'
$Sign = '+' '-' '~'
File = Stmt* EOF
Stmt = Simple | Compound
Simple = Small (';' Small)* ';'? NEWLINE
Block = Simple | NEWLINE Suite
Suite@ = INDENT Stmt+ DEDENT
Small = %EQ Assign | %PLAIN StarL | 'pass' | 'break' | 'continue' | 'return' StarL? | 'raise' (Expr ('from' Expr)?)?
  | 'del' DTargets | 'global' $Id (',' $Id)* | 'nonlocal' $Id (',' $Id)* | 'assert' Expr (',' Expr)?
  | Import | Yield | 'type' $Id TParams? '=' Expr
Import = 'import' Dotted ('as' $Id)? (',' Dotted ('as' $Id)?)*
  | 'from' (('.' | '...')* Dotted | ('.' | '...')+) 'import' ('*' | AsName (',' AsName)* | '(' AsName (',' AsName)* ','? ')')
AsName = $Id ('as' $Id)?
Dotted = $Id ('.' $Id)*
Assign = (Targets '=')+ (StarL | Yield) | Single ':' Expr ('=' (StarL | Yield))? | Single $Aug (StarL | Yield)
Targets = Target (',' Target)* ','?
Target = '*'? (Single | '(' Targets? ')' | '[' Targets? ']')
DTargets = DTarget (',' DTarget)* ','?
DTarget = Single | '(' DTargets? ')' | '[' DTargets? ']'
Single = $Id | Post Access | '(' Single ')'
Access = '.' $Id | Index
Yield = 'yield' ('from' Expr | StarL)?
StarL = StarE (',' StarE)* ','?
StarE = '*' Ar | Expr
NamedL = NamedE (',' NamedE)* ','?
NamedE = '*' Ar | Named
Named = $Id ':=' Expr | Expr
Expr = 'lambda' LParams? ':' Expr | Disj ('if' Disj 'else' Expr)?
Disj = Inv (('and' | 'or') Inv)*
Inv = 'not'* Cmp
Cmp = Ar (CmpOp Ar)*
CmpOp = '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
Ar = Fac ($Ar Fac)*
Fac = $Sign* 'await'? Post ('**' Fac)?
Post = Atom (Access | Args)*
Atom = $Id | NUM | (STR | Fields)+ | BYTES+ | '...' | 'None' | 'True' | 'False' | Paren | List | Dict
Fields = FS Field* FE
Field = 'F{' (StarL | Yield) 'F='? 'F!'? ('F:' Field*)? 'F}'
Paren@ = '(' (Yield | Named (CompFor | ',' NamedL?)? | '*' Ar ',' NamedL?)? ')'
List@ = '[' (Named (CompFor | (',' NamedE)* ','?) | '*' Ar (',' NamedE)* ','?)? ']'
Dict@ = '{' (Expr ':' Expr (CompFor | (',' Pair)* ','?) | '**' Ar (',' Pair)* ','? | Named (CompFor | (',' NamedE)* ','?) | '*' Ar (',' NamedE)* ','?)? '}'
Pair = Expr ':' Expr | '**' Ar
CompFor = ('async'? 'for' Targets 'in' Disj ('if' Disj)*)+
Args@ = '(' (Pos (',' Pos)* (',' Keys)? ','? | Keys ','? | Named CompFor)? ')'
Pos = Named | '*' Expr
Keys = KeyS (',' KeyS)* (',' KeyD (',' KeyD)*)? | KeyD (',' KeyD)*
KeyS = $Id '=' Expr | '*' Expr
KeyD = $Id '=' Expr | '**' Expr
Index@ = '[' Slice (',' Slice)* ','? ']'
Slice = Named | '*' Ar | Expr? ':' Expr? (':' Expr?)?
LParams = $Id LA | $Id '=' Expr LD | LStar
LA = (',' ($Id LA | $Id '=' Expr LD | '/' LB | LStar)?)?
LD = (',' ($Id '=' Expr LD | '/' LE | LStar)?)?
LB = (',' ($Id LB | $Id '=' Expr LE | LStar)?)?
LE = (',' ($Id '=' Expr LE | LStar)?)?
LStar = '*' $Id LS | '*' ',' LKey LS | '**' $Id ','?
LS = (',' (LKey LS | '**' $Id ','?)?)?
LKey = $Id ('=' Expr)?
Params@ = '(' (Plain PA | Default PD | Star)? ')'
Plain = $Id (':' Expr)?
Default = $Id (':' Expr)? '=' Expr
PA = (',' (Plain PA | Default PD | '/' PB | Star)?)?
PD = (',' (Default PD | '/' PE | Star)?)?
PB = (',' (Plain PB | Default PE | Star)?)?
PE = (',' (Default PE | Star)?)?
Star = '*' $Id (':' '*'? Expr)? PS | '*' ',' (Plain | Default) PS | '**' $Id (':' Expr)? ','?
PS = (',' ((Plain | Default) PS | '**' $Id (':' Expr)? ','?)?)?
TParams@ = '[' TParam (',' TParam)* ','? ']'
TParam = ('*' | '**')? $Id (':' Expr)? ('=' '*'? Expr)?
Compound = If | While | For | Try | With | Def | Class | Match | 'async' (For | With | Def) | ('@' Named NEWLINE)+ (Def | Class | 'async' Def)
If = 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While = 'while' Named ':' Block ('else' ':' Block)?
For = 'for' Targets 'in' StarL ':' Block ('else' ':' Block)?
Try = 'try' ':' Block (Except+ ('else' ':' Block)? ('finally' ':' Block)? | ExceptG+ ('else' ':' Block)? ('finally' ':' Block)? | 'finally' ':' Block)
Except = 'except' (Expr ('as' $Id)?)? ':' Block
ExceptG = 'except' '*' Expr ('as' $Id)? ':' Block
With = 'with' (Item (',' Item)* | '(' Item (',' Item)* ','? ')') ':' Block
Item = Expr ('as' Target)?
Def = 'def' $Id TParams? Params ('->' Expr)? ':' Block
Class = 'class' $Id TParams? Args? ':' Block
Match = 'match' NamedL ':' NEWLINE Cases
Cases@ = INDENT Case+ DEDENT
Case = 'case' (OpenSeq | Pat) ('if' Named)? ':' Block
OpenSeq = PItem ',' (PItem (',' PItem)* ','?)?
PItem = '*' $Id | Pat
Pat = Closed ('|' Closed)* ('as' $Id)?
Closed = '-'? NUM (('+' | '-') NUM)? | (STR | Fields)+ | BYTES+ | 'None' | 'True' | 'False' | $Id ('.' $Id)* PArgs? | PSeq | PList | PMap
PSeq@ = '(' (PItem (',' PItem)* ','?)? ')'
PList@ = '[' (PItem (',' PItem)* ','?)? ']'
PArgs@ = '(' (Pat (',' Pat)* (',' $Id '=' Pat)* ','? | $Id '=' Pat (',' $Id '=' Pat)* ','?)? ')'
PMap@ = '{' (PPair (',' PPair)* ','?)? '}'
PPair = ('-'? NUM (('+' | '-') NUM)? | STR+ | BYTES+ | 'None' | 'True' | 'False' | $Id ('.' $Id)+) ':' Pat | '**' $Id
"""


# ---------------------------------------------------------------- JavaScript and TypeScript
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static yield await implements interface package private protected public".split()
)
JS_SOFT = frozenset(
    "async of get set from as target meta type declare namespace module abstract readonly keyof infer is asserts satisfies override unique global accessor out".split()
)
JS_OPS = "... => === !== **= <<= &&= ||= ??= == != <= >= && || ?? ++ -- += -= *= /= %= &= |= ^= << ** + - * / % & | ^ ! ~ < = ? : , . ; ( ) [ ] { } @"
_JS = re.compile(
    r"""(?P<ws>[ \t\f\v ﻿ -   　]+)|(?P<nl>[\n  ])|(?P<com>//[^\n  ]*|/\*.*?\*/)
    |(?P<str>\"[^\"\\\n]*(?:\\(?:[^xu0-9]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?![0-9]))[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\(?:[^xu0-9]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?![0-9]))[^'\\\n]*)*')
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$]))
    |(?P<id>\#?(?:[^\W\d]|\$)[\w$‌‍]*)
    |(?P<gt>>=?)|(?P<opt>\?\.(?![0-9]))
    |(?P<op>"""
    + _ops(JS_OPS)
    + ")",
    re.X | re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_TPL = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*", re.S)
_JS_BEFORE_DIVISION = frozenset({"NAME", "NUM", "STR", "REGEX", "TSTR", "TTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "PRIV", "++", "--"}) | JS_SOFT


def lex_js(content: str) -> Lexed:
    t = normalise(content)
    out, i, n, nl = Lexed(t), 0, len(t), False
    if t.startswith("#!"):
        i = (t + "\n").index("\n")
    depth: list[int] = []  # open braces inside each template hole
    while i < n:
        ch = t[i]
        if ch == "`" or ch == "}" and depth and depth[-1] == 0:
            m = _JS_TPL.match(t, i + 1)
            e = m.end()
            hole = t.startswith("${", e)
            if e >= n or not hole and t[e] != "`":
                out.add("ERR", i, n, nl)
                break
            if ch == "}":
                depth.pop()
            kind = ("THEAD" if hole else "TSTR") if ch == "`" else ("TMID" if hole else "TTAIL")
            out.add(kind, i, e + (2 if hole else 1), nl)
            if hole:
                depth.append(0)
            i, nl = e + (2 if hole else 1), False
            continue
        if ch == "/" and not t.startswith(("//", "/*"), i) and (not out.kinds or out.kinds[-1] not in _JS_BEFORE_DIVISION):
            m = _JS_REGEX.match(t, i)
            if m:
                out.add("REGEX", i, m.end(), nl)
                i, nl = m.end(), False
                continue
        m = _JS.match(t, i)
        if not m:
            out.add("ERR", i, i + 1, nl)
            if t.startswith("/*", i):
                break
            i, nl = i + 1, False
            continue
        kind, a, i = m.lastgroup, i, m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            nl = True
            continue
        if kind == "com":
            out.comments.append((a, i))
            nl = nl or "\n" in m[0]
            continue
        w = m[0]
        if kind == "str":
            out.add("STR", a, i, nl)
        elif kind == "num":
            out.add("NUM", a, i, nl)
        elif kind == "id":
            out.add("PRIV" if w[0] == "#" else w if w in JS_RESERVED or w in JS_SOFT else "NAME", a, i, nl)
        elif kind == "gt":
            out.add(w if w == ">=" else "GTA" if t.startswith((">"), i) else "GT", a, i, nl)
        elif kind == "opt":
            out.add("?.", a, i, nl)
        else:
            if depth:
                depth[-1] += (w == "{") - (w == "}")
            out.add(w, a, i, nl)
        nl = False
    if depth:
        out.add("ERR", n, n, nl)
    out.add("EOF", n, n, True)
    return out


JS_GRAMMAR = (
    "$Id = NAME " + " ".join(sorted(f"'{w}'" for w in JS_SOFT)) + "\n$Prop = $Id " + " ".join(sorted(f"'{w}'" for w in JS_RESERVED)) + "\n"
    r"""
$Asg = '=' '+=' '-=' '*=' '/=' '%=' '**=' '<<=' '&=' '|=' '^=' '&&=' '||=' '??='
$Bin = '+' '-' '*' '/' '%' '**' '<<' '<' '<=' '>=' '==' '!=' '===' '!==' '&' '|' '^' 'in' 'instanceof' GT
$Log = '&&' '||'
$Pre = 'delete' 'void' 'typeof' '+' '-' '~' '!' 'await'
$Lit = NUM STR REGEX 'this' 'super' 'null' 'true' 'false'
$Jump = 'break' 'continue'
$Var = 'var' 'let'
Program = Item* EOF
Item = Import | Export | Stmt
Import = 'import' (STR | <<ts 'type'?>> ImportClause 'from' STR) ('with' Object)? Semi
  <<ts | 'import' 'type'? $Id '=' Postfix Semi>>
ImportClause = $Id (',' (NsImport | Names))? | NsImport | Names
NsImport = '*' 'as' $Id
Names@ = '{' (Spec (',' Spec)* ','?)? '}'
Spec = <<ts 'type'?>> ($Prop | STR) ('as' ($Prop | STR))?
Export = 'export' ('*' ('as' ($Prop | STR))? 'from' STR Semi | Names ('from' STR)? Semi | 'default' (Func | Class | %XS Assign Semi) | Decl)
  <<ts | 'export' ('type' (Names | '*' ('as' $Prop)?) ('from' STR)? Semi | '=' Expr Semi | 'as' 'namespace' $Id Semi | 'default' (Interface | 'abstract' Class)) | Decor+ Export>>
Decl = Func | Class | VarStmt <<ts | TsDecl>>
Decor = '@' (Paren | $Id ('.' $Prop)* Args?)
VarStmt = $Var VarDecl (',' VarDecl)* Semi | 'const' ConstDecl (',' ConstDecl)* Semi
VarDecl = Binding <<ts '!'? TypeAnn?>> ('=' Assign)?
ConstDecl = Binding <<ts TypeAnn?>> '=' Assign
Binding = $Id | ObjPat | ArrPat
ObjPat@ = '{' (PropPat (',' PropPat)* ','?)? '}'
PropPat = $Id ('=' Assign)? | PropName ':' Binding ('=' Assign)? | '...' Binding
ArrPat@ = '[' ElemPat? (',' ElemPat?)* ']'
ElemPat = '...'? Binding ('=' Assign)?
Semi = ';' | %ASI
Stmt§ = Block§ | Decl | ';' | %XS Expr Semi | If§ | For§ | While§ | Do§ | Switch§ | Try§ | 'throw' %NONL Expr Semi
  | $Jump (%NONL $Id)? Semi | 'debugger' Semi | $Id ':' Stmt§ <<F | 'return' (%NONL Expr)? Semi>>
Block§@ = '{' Stmt§* '}'
If§ = 'if' Paren Stmt§ ('else' Stmt§)?
While§ = 'while' Paren Stmt§
Do§ = 'do' Stmt§ 'while' Paren ';'?
For§ = 'for' 'await'? ForHead Stmt§
ForHead@ = '(' ((ForInit ';' | ';') Expr? ';' Expr? | (($Var | 'const') Binding | Postfix %PLACE) ('of' Assign | 'in' Expr)) ')'
ForInit = ($Var | 'const') VarDecl (',' VarDecl)* | Expr
Switch§ = 'switch' Paren Cases§
Cases§@ = '{' (('case' Expr | 'default') ':' Stmt§*)* '}'
Try§ = 'try' Block§ ('catch' ('(' Binding <<ts TypeAnn?>> ')')? Block§ ('finally' Block§)? | 'finally' Block§)
Func = ('async' %NONL)? 'function' '*'? $Id? Sig (Body <<ts | Semi>>)
Sig = <<ts TypeParams?>> Params <<ts RetType?>>
Params@ = '(' (Param (',' Param)* ','?)? ')'
Param = <<ts Decor* Mod*>> Binding <<ts '?'? TypeAnn?>> ('=' Assign)? | '...' Binding <<ts TypeAnn?>> <<ts | 'this' TypeAnn>>
Body@ = '{' StmtF* '}'
Class = Decor* 'class' $Id? <<ts TypeParams?>> ('extends' Postfix <<ts TypeArgs?>>)? <<ts ('implements' Type (',' Type)*)?>> ClassBody
ClassBody@ = '{' Member* '}'
Mod = 'static' <<ts | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'>>
Member = ';' | 'static' Block | Decor* Mod* (Method | Accessor | Field) <<ts | Mod* '[' $Id ':' Type ']' TypeAnn Semi>>
PropName = $Prop | STR | NUM | PRIV | '[' Assign ']'
Method = ('async' %NONL)? '*'? PropName <<ts '?'?>> Sig (Body <<ts | Semi>>)
Accessor = ('get' | 'set') PropName Sig (Body <<ts | Semi>>)
Field = PropName <<ts ('?' | '!')? TypeAnn?>> ('=' Assign)? Semi
Expr = Assign (',' Assign)*
Assign = Cond | Postfix %PLACE ($Asg | GTA '>=' | GTA GTA '>=') Assign <<ts | '<' Type (GT | GTA) Postfix %PLACE $Asg Assign>> | Arrow | 'yield' (%NONL '*'? Assign)?
Arrow = ('async' %NONL)? ($Id | <<ts TypeParams?>> Params <<ts RetType?>>) %NONL '=>' (%NOTBRACE Assign | Body)
Cond = Operand (BinOp Operand <<ts | %NONL ('as' | 'satisfies') (Type | 'const')>>)* (($Log Operand (BinOp Operand <<ts | %NONL ('as' | 'satisfies') (Type | 'const')>>)*)* | ('??' Operand (BinOp Operand <<ts | %NONL ('as' | 'satisfies') (Type | 'const')>>)*)+) ('?' Assign ':' Assign)?
BinOp = $Bin | GTA GT | GTA GTA GT
Operand = $Pre* (Postfix (%NONL %PLACE ('++' | '--'))? | ('++' | '--') Postfix %PLACE) | PRIV <<ts | '<' Type (GT | GTA) Operand>>
Postfix = Primary Suffix*
Suffix = '.' ($Prop | PRIV) | '?.' ($Prop | PRIV | Index | Args) | Index | Args | Template <<ts | %NONL '!' | TypeArgs (Args | Template)>>
Index@ = '[' Expr ']'
Primary = $Id | $Lit | Template | Array | Object | Paren | Func | Class | New | 'import' (Args | '.' 'meta')
New = 'new' ('.' 'target' | (New | Primary) ('.' ($Prop | PRIV) | Index)* <<ts TypeArgs?>> Args?)
Paren@ = '(' Expr ')'
Array@ = '[' Elem? (',' Elem?)* ']'
Elem = '...'? Assign
Object@ = '{' (Prop (',' Prop)* ','?)? '}'
Prop = $Id ('=' Assign)? | PropName ':' Assign | ObjMethod | '...' Assign
ObjMethod = (('async' %NONL)? '*'? | 'get' | 'set') PropName Sig Body
Args@ = '(' (Elem (',' Elem)* ','?)? ')'
Template = TSTR | THEAD Expr (TMID Expr)* TTAIL
<<ts TsDecl = 'type' %NONL $Id TypeParams? '=' Type Semi | Interface | 'const'? 'enum' $Id EnumBody | ('namespace' | 'module') %NONL ($Id ('.' $Id)* | STR) (Space | Semi) | 'declare' %NONL (Decl | 'const' Ambient (',' Ambient)* Semi | 'global' Space) | 'abstract' %NONL Class>>
<<ts Ambient = Binding TypeAnn?>>
<<ts Interface = 'interface' $Id TypeParams? ('extends' Type (',' Type)*)? ObjType>>
<<ts EnumBody@ = '{' (EnumM (',' EnumM)* ','?)? '}'>>
<<ts EnumM = PropName ('=' Assign)?>>
<<ts Space@ = '{' (Item | 'export'? 'const' Ambient (',' Ambient)* Semi)* '}'>>
<<ts TypeAnn = ':' Type>>
<<ts RetType = ':' Ret>>
<<ts Ret = Type | ($Id | 'this') %NONL 'is' Type | 'asserts' ($Id | 'this') ('is' Type)?>>
<<ts Type = FnType | UnionT ('extends' UnionT '?' Type ':' Type)?>>
<<ts FnType = 'abstract'? 'new'? TypeParams? Params '=>' Ret>>
<<ts UnionT = ('|' | '&')? PostT (('|' | '&') PostT)*>>
<<ts PostT = ('keyof' | 'unique' | 'readonly' | 'infer')* PrimT (%NONL (Brackets | IndexT))*>>
<<ts Brackets@ = '[' ']'>>
<<ts IndexT@ = '[' Type ']'>>
<<ts PrimT = $Id ('.' $Prop)* TypeArgs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | 'typeof' ('import' Args | $Id | 'this') ('.' $Prop)* TypeArgs? | ParenT | ObjType | Tuple | 'import' Args ('.' $Prop)* TypeArgs? | TSTR | THEAD Type (TMID Type)* TTAIL>>
<<ts ParenT@ = '(' Type ')'>>
<<ts Tuple@ = '[' (TElem (',' TElem)* ','?)? ']'>>
<<ts TElem = '...'? ($Id '?'? ':')? Type '?'?>>
<<ts ObjType@ = '{' (TMember (TSep TMember)* TSep?)? '}'>>
<<ts TSep = ';' | ',' | %ASI>>
<<ts TMember = 'readonly'? PropName '?'? TypeAnn? | PropName '?'? Sig | 'new'? Sig | ('get' | 'set') PropName Sig | 'readonly'? '[' $Id ':' Type ']' TypeAnn | (('+' | '-')? 'readonly')? '[' $Id 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? TypeAnn?>>
<<ts TypeArgs = '<' Type (',' Type)* (GT | GTA)>>
<<ts TypeParams = '<' TypeParam (',' TypeParam)* ','? (GT | GTA)>>
<<ts TypeParam = ('const' | 'in' | 'out')? $Id ('extends' Type)? ('=' Type)?>>
"""
)

# ---------------------------------------------------------------- Java
JAVA_RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
JAVA_SOFT = frozenset("record sealed permits yield non open module".split())
JAVA_OPS = "... -> :: == != <= >= && || ++ -- += -= *= /= %= &= |= ^= <<= << + - * / % & | ^ ! ~ < = ? : , . ; ( ) [ ] { } @"
_JAVA = re.compile(
    r"""(?P<ws>[ \t\f]+)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*.*?\*/)
    |(?P<str>\"\"\"[ \t\f]*\n[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|\"(?!\"\")[^\"\\\n]*(?:\\(?:[btnfrs\"'\\0-7]|u+[0-9a-fA-F]{4})[^\"\\\n]*)*\"|\"\"(?!\"))
    |(?P<chr>'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\]))')
    |(?P<num>(?:0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*\.?[0-9a-fA-F]*(?:[pP][+-]?[0-9]+[fFdD]?)?|\.[0-9a-fA-F]+[pP][+-]?[0-9]+[fFdD]?)|0[bB][01](?:_*[01])*|(?:[0-9](?:_*[0-9])*\.(?:[0-9](?:_*[0-9])*)?|\.[0-9](?:_*[0-9])*)(?:[eE][+-]?[0-9](?:_*[0-9])*)?[fFdD]?|[0-9](?:_*[0-9])*(?:[eE][+-]?[0-9](?:_*[0-9])*[fFdD]?|[fFdD])|0(?:_*[0-7])*|[1-9](?:_*[0-9])*)[lL]?(?![\w$]))
    |(?P<id>(?:[^\W\d]|\$)[\w$]*)
    |(?P<gt>>=?)
    |(?P<op>"""
    + _ops(JAVA_OPS)
    + ")",
    re.X | re.S,
)

JAVA_GRAMMAR = r"""
$Id = NAME 'record' 'sealed' 'permits' 'yield' 'non' 'open' 'module'
$Prim = 'boolean' 'byte' 'char' 'double' 'float' 'int' 'long' 'short'
$Lit = NUM STR CHR 'true' 'false' 'null'
$Asg = '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<='
$Bin = '+' '-' '*' '/' '%' '<<' '<' '<=' '>=' '==' '!=' '&&' '||' '&' '|' '^' GT
$Pre = '+' '-' '~' '!'
$Kw = 'public' 'protected' 'private' 'static' 'abstract' 'final' 'native' 'synchronized' 'transient' 'volatile' 'strictfp' 'default' 'sealed'
Unit = (Annot* 'package' QName ';')? (Import | ';')* (Top)* EOF | Annot* 'open'? 'module' QName ModBody EOF
ModBody@ = '{' ($Id ('static' | $Id)? QName ($Id QName (',' QName)*)? ';')* '}'
Import = 'import' 'static'? QName ('.' '*')? ';'
QName = $Id ('.' $Id)*
Top = Mod* TypeDecl | ';'
Mod = Annot | $Kw | 'non' '-' 'sealed'
Annot = '@' QName AnnArgs?
AnnArgs@ = '(' (ElemVal | $Id '=' ElemVal (',' $Id '=' ElemVal)*)? ')'
ElemVal = Cond | Annot | ElemArr
ElemArr@ = '{' (ElemVal (',' ElemVal)*)? ','? '}'
TypeDecl = 'class' $Id TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody
  | 'interface' $Id TypeParams? ('extends' Types)? ('permits' Types)? ClassBody
  | '@' 'interface' $Id ClassBody
  | 'enum' $Id ('implements' Types)? EnumBody
  | 'record' $Id TypeParams? Params ('implements' Types)? ClassBody
EnumBody@ = '{' (Const (',' Const)*)? ','? (';' Member*)? '}'
Const = Annot* $Id Args? ClassBody?
ClassBody@ = '{' Member* '}'
Member = ';' | 'static'? Block | Mod* (TypeDecl | Method | Ctor | Type VarDecl (',' VarDecl)* ';')
Method = TypeParams? Annot* (Type | 'void') $Id Params Dim* ('throws' Types)? (Block | ';' | 'default' ElemVal ';')
Ctor = TypeParams? $Id Params? ('throws' Types)? Block
VarDecl = $Id Dim* ('=' Init)?
Init = ArrInit | Expr
ArrInit@ = '{' (Init (',' Init)*)? ','? '}'
Params@ = '(' (Param (',' Param)*)? ')'
Param = Mod* Type (Annot* '...')? ($Id Dim* | ($Id '.')? 'this')
Types = Type (',' Type)*
Dim = Annot* Brackets
Brackets@ = '[' ']'
Type = Annot* ($Prim | CType) Dim*
CType = $Id TypeArgs? ('.' Annot* $Id TypeArgs?)*
TypeArgs = '<' (TArg (',' TArg)*)? (GT | GTA)
TArg = Annot* '?' (('extends' | 'super') Type)? | Type
TypeParams = '<' TParam (',' TParam)* (GT | GTA)
TParam = Annot* $Id ('extends' Type ('&' Type)*)?
Block@ = '{' BStmt* '}'
BStmt = Local ';' | Mod* TypeDecl | Stmt
Local = Mod* Type VarDecl (',' VarDecl)*
Stmt = Block | ';' | StmtExpr ';' | 'if' Paren Stmt ('else' Stmt)? | 'while' Paren Stmt | 'do' Stmt 'while' Paren ';'
  | 'for' ForHead Stmt | 'return' Expr? ';' | 'break' $Id? ';' | 'continue' $Id? ';' | 'throw' Expr ';' | 'yield' Expr ';'
  | 'try' Block (Catch+ Finally? | Finally) | 'try' Resources Block Catch* Finally?
  | Switch | 'synchronized' Paren Block | 'assert' Expr (':' Expr)? ';' | $Id ':' Stmt
Catch = 'catch' '(' Mod* Type ('|' Type)* $Id ')' Block
Finally = 'finally' Block
Resources@ = '(' Resource (';' Resource)* ';'? ')'
Resource = Mod* Type $Id '=' Expr | Postfix
ForHead@ = '(' ((Local | StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)? | Mod* Type $Id Dim* ':' Expr) ')'
Switch = 'switch' Paren SwitchBody
SwitchBody@ = '{' (Label (':' BStmt* | '->' (Block | Expr ';' | 'throw' Expr ';')))* '}'
Label = 'case' Cond (',' Cond)* | 'default'
StmtExpr = Postfix (%PLACE (AsgOp Expr | '++' | '--') | %CALLEND) | ('++' | '--') Postfix %PLACE
AsgOp = $Asg | GTA '>=' | GTA GTA '>='
Expr = Cond | Lambda | Postfix %PLACE AsgOp Expr
Lambda = ($Id | Params | '(' $Id (',' $Id)* ')') '->' (Expr | Block)
Cond = Unary (BinOp Unary | 'instanceof' 'final'? Type $Id?)* ('?' Expr ':' (Cond | Lambda))?
BinOp = $Bin | GTA GT | GTA GTA GT
Unary = $Pre* (Cast | Postfix (%PLACE ('++' | '--'))? | ('++' | '--') Postfix %PLACE)
Cast = '(' Type ('&' Type)* ')' (Unary | Lambda)
Postfix = Primary Suffix*
Suffix = '.' (TypeArgs? $Id Args? | New | 'this' | 'class' | TypeArgs? 'super' Args?) | Index | '::' TypeArgs? ($Id | 'new')
Index@ = '[' Expr ']'
Primary = $Id Args? | $Lit | Paren | 'this' Args? | 'super' Args? | New | $Prim Dim* ('.' 'class' | '::' 'new') | 'void' '.' 'class'
  | CType Dim+ ('.' 'class' | '::' 'new') | CType '::' ($Id | 'new') | Switch
New = 'new' (Annot* TypeArgs? CType Args ClassBody? | Annot* ($Prim | CType) (Index+ Dim* | Dim+ ArrInit))
Paren@ = '(' Expr ')'
Args@ = '(' (Expr (',' Expr)*)? ')'
"""

# ---------------------------------------------------------------- Go
GO_RESERVED = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
GO_OPS = "<<= >>= &^= &^ ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ~ ! < > = : , . ; ( ) [ ] { }"
_GO = re.compile(
    r"""(?P<ws>[ \t]+)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*.*?\*/)
    |(?P<str>\"[^\"\\\n]*(?:\\(?:[abfnrtv\\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})[^\"\\\n]*)*\"|`[^`]*`)
    |(?P<chr>'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\']))')
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*|(?=i))|0(?:_?[0-7])*|[1-9](?:_?[0-9])*)i?(?![\w]))
    |(?P<id>[^\W\d]\w*)
    |(?P<op>"""
    + _ops(GO_OPS)
    + ")",
    re.X | re.S,
)
_GO_ENDS = frozenset({"NAME", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})

GO_GRAMMAR = r"""
$Asg = '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^='
$Bin = '+' '-' '*' '/' '%' '&' '|' '^' '<<' '>>' '&^' '&&' '||' '==' '!=' '<' '<=' '>' '>='
$Pre = '+' '-' '!' '^' '*' '&' '<-' '~'
File = 'package' NAME ';' (Import ';')* (Top ';')* EOF
Import = 'import' (ISpec | ISpecs)
ISpecs@ = '(' (ISpec (';' ISpec)* ';'?)? ')'
ISpec = ('.' | NAME)? STR
Top = Decl | 'func' Params? NAME TParams? Sig Block?
Decl = 'const' (CSpec | CSpecs) | 'var' (VSpec | VSpecs) | 'type' (TSpec | TSpecs)
CSpecs@ = '(' (CSpec (';' CSpec)* ';'?)? ')'
VSpecs@ = '(' (VSpec (';' VSpec)* ';'?)? ')'
TSpecs@ = '(' (TSpec (';' TSpec)* ';'?)? ')'
CSpec = Names (Type? '=' ExprL)?
VSpec = Names (Type ('=' ExprL)? | '=' ExprL)
TSpec = NAME TParams? '='? Type
TParams@ = '[' Names Constraint (',' Names Constraint)* ','? ']'
Constraint = '~'? Type ('|' '~'? Type)*
Names = NAME (',' NAME)*
Type = TName | TypeLit | '*' Type | '<-'? 'chan' '<-'? Type | '(' Type ')' | 'func' Sig
TName = NAME ('.' NAME)? TArgs?
TArgs@ = '[' Type (',' Type)* ','? ']'
TypeLit = Brackets Type | Bound Type | 'map' TKey Type | 'struct' Struct | 'interface' Iface
Brackets@ = '[' ']'
Bound@ = '[' (Expr | '...') ']'
TKey@ = '[' Type ']'
Struct@ = '{' (Field (';' Field)* ';'?)? '}'
Field = (Names Type | '*'? TName) STR?
Iface@ = '{' (IElem (';' IElem)* ';'?)? '}'
IElem = NAME Sig | Constraint
Sig = Params (Params | Type)?
Params@ = '(' ('...'? Type (',' '...'? Type)* ','? | Names '...'? Type (',' Names '...'? Type)* ','?)? ')'
Block@ = '{' StmtL '}'
StmtL = Stmt? (';' Stmt?)*
Stmt = Decl | Simple | 'return' ExprL? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | Block | If | For | Switch | Select
  | 'go' Expr | 'defer' Expr | NAME ':' Stmt?
Simple§ = ExprL§ '=' ExprL§ | Names ':=' ExprL§ | Expr§ ($Asg Expr§ | '++' | '--' | '<-' Expr§)?
If = 'if' (SimpleF? ';')? ExprF Block ('else' (If | Block))?
For = 'for' (ExprF | SimpleF? ';' ExprF? ';' SimpleF? | (ExprLF '=' | Names ':=')? 'range' ExprF)? Block
Switch = 'switch' (SimpleF? ';')? SimpleF? Cases
Cases@ = '{' (('case' TypeL | 'default') ':' StmtL)* '}'
TypeL = (Expr | Type) (',' (Expr | Type))*
Select = 'select' Comms
Comms@ = '{' (('case' Simple | 'default') ':' StmtL)* '}'
ExprL§ = Expr§ (',' Expr§)*
Expr§ = Unary§ ($Bin Unary§)*
Unary§ = $Pre* Post§
Post§ = Prim§ (Suffix <<P | Value>>)*
Suffix = '.' NAME | '.' Assert | Index | Args
Assert@ = '(' ('type' | Type) ')'
Index@ = '[' (TypeL ','? | Expr? ':' Expr? (':' Expr)?) ']'
Prim§ = NAME | NUM | STR | CHR | Paren | 'func' Sig Block | TypeLit Value? | 'chan' Type
Paren@ = '(' (Expr | Type) ')'
Value@ = '{' (Elem (',' Elem)* ','?)? '}'
Elem = (Expr | Value) (':' (Expr | Value))?
Args@ = '(' ((Expr | Type) (',' (Expr | Type))* '...'? ','?)? ')'
"""


def _lex_braces(content: str, pattern: re.Pattern, words: frozenset, go: bool) -> Lexed:
    """Java and Go.  Go: a line end after certain tokens is a semicolon."""
    t = normalise(content)
    out, i, n, nl = Lexed(t), 0, len(t), False
    while i < n:
        m = pattern.match(t, i)
        if not m:
            out.add("ERR", i, i + 1, nl)
            if t.startswith("/*", i) or t[i] == "`":
                break
            i, nl = i + 1, False
            continue
        kind, a, i = m.lastgroup, i, m.end()
        if kind == "ws":
            continue
        if kind == "com":
            out.comments.append((a, i))
        if kind == "nl" or kind == "com" and "\n" in m[0]:
            if go and out.kinds and out.kinds[-1] in _GO_ENDS:
                out.add(";", a, a, False)
            nl = True
            continue
        if kind == "com":
            continue
        w = m[0]
        if kind == "id":
            out.add(w if w in words else "NAME", a, i, nl)
        elif kind == "gt":
            out.add(w if w == ">=" else "GTA" if t.startswith(">", i) else "GT", a, i, nl)
        elif kind == "op":
            out.add(w, a, i, nl)
        else:
            out.add({"str": "STR", "chr": "CHR", "num": "NUM"}[kind], a, i, nl)
        nl = False
    if go and out.kinds and out.kinds[-1] in _GO_ENDS:
        out.add(";", n, n, False)
    out.add("EOF", n, n, True)
    return out


def lex_java(content: str) -> Lexed:
    return _lex_braces(content, _JAVA, JAVA_RESERVED | JAVA_SOFT, False)


def lex_go(content: str) -> Lexed:
    return _lex_braces(content, _GO, GO_RESERVED, True)


# ---------------------------------------------------------------- putting it together
#: Tokens after which, at a line's begin, a statement goes on.
_JS_GOES_ON = "( [ + - * / % , . ?. = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= ** << < <= >= == != === !== && || ?? & | ^ ? : => in instanceof TSTR THEAD GT GTA ) ]".split()


def _place_test(tid, never: str, unless_member: str):
    """Whether what ends before token i may be assigned to: a name, a member, a bracketed
    place or a pattern, but no call and no literal."""
    get = lambda words: frozenset(map(tid, words.split()))
    never_, literal, members, close, heads = get(never), get(unless_member), get("."), tid(")"), get("if while for")
    operand, optional = get(never + " " + unless_member + " NAME PRIV ) ] } GT GTA ! " + " ".join(sorted(JS_SOFT | JAVA_SOFT))), tid("?.")

    def place(t: Tokens, i: int) -> bool:
        k = t.kinds[i - 1]
        if k == close:
            at = t.opening(i - 1)
            if at and t.kinds[at - 1] == close:  # behind the head of a statement no call begins
                head = t.opening(at - 1)
                return bool(head) and t.kinds[head - 1] in heads
            return at is not None and (at == 0 or t.kinds[at - 1] not in operand)
        if k in never_:
            return False
        before = t.kinds[i - 2] if i > 1 else 0
        return before != optional and (k not in literal or before in members)

    return place


def _js_tests(tid) -> dict:
    get = lambda *w: frozenset(map(tid, w))
    goes_on, ends, brace = get(*_JS_GOES_ON), get("}", "EOF"), get("{")
    not_expr, function, is_async, let, bracket = get("{", "function", "class"), get("function"), get("async"), get("let"), get("[")

    def asi(t: Tokens, i: int) -> bool:
        k = t.kinds[i] if i < len(t.kinds) else None
        return k in ends or t.nl[i] and k not in goes_on

    def statement(t: Tokens, i: int) -> bool:
        k = t.kinds[i]
        nxt = t.kinds[i + 1] if i + 1 < len(t.kinds) else None
        return not (k in not_expr or k in is_async and nxt in function and not t.nl[i + 1] or k in let and nxt in bracket)

    return {
        "ASI": asi,
        "XS": statement,
        "NONL": lambda t, i: i < len(t.kinds) and not t.nl[i],
        "NOTBRACE": lambda t, i: t.kinds[i] not in brace,
        "PLACE": _place_test(tid, "NUM STR REGEX TSTR TTAIL", "this super null true false meta target"),
    }


def _java_tests(tid) -> dict:
    ends = frozenset({tid(")"), tid("}")})
    return {"CALLEND": lambda t, i: t.kinds[i - 1] in ends, "PLACE": _place_test(tid, "NUM STR CHR true false null this super class }", "")}


def _python_tests(tid) -> dict:
    """EQ, PLAIN: whether the small statement at i may be an assignment, or may not."""
    end = frozenset(map(tid, ("NEWLINE", ";", "EOF")))
    signs = frozenset(map(tid, "= : += -= *= /= %= &= |= ^= @= **= //= >>= <<=".split()))
    equal, colon, function = tid("="), tid(":"), tid("lambda")

    def signs_of(t: Tokens, i: int) -> tuple[bool, bool]:
        if (got := t.notes.get(i)) is not None:
            return got
        at, kinds, match, assigns, plain = i, t.kinds, t.match, False, True
        while i < len(kinds) and (k := kinds[i]) not in end:
            if k in signs:
                assigns = True
                plain = plain and k == colon
            elif k == function:  # its colon and defaults are its own
                assigns = plain = True
                break
            i = match.get(i, i) + 1
        t.notes[at] = assigns, plain
        return assigns, plain

    return {"EQ": lambda t, i: signs_of(t, i)[0], "PLAIN": lambda t, i: signs_of(t, i)[1]}


_PAIRS = [("(", ")"), ("[", "]"), ("{", "}"), ("INDENT", "DEDENT")]


@lru_cache(maxsize=None)
def grammar(language: str) -> tuple[Grammar, dict[int, int]]:
    """The language's program (all its dialects) and its brackets."""
    g = {
        "python": lambda: Grammar({"": PY_GRAMMAR}, _python_tests),
        "javascript": lambda: Grammar({"": expand(JS_GRAMMAR)}, _js_tests),
        "typescript": lambda: Grammar({"Js": expand(JS_GRAMMAR), "": expand(JS_GRAMMAR, "ts")}, _js_tests),
        "java": lambda: Grammar({"": JAVA_GRAMMAR}, _java_tests),
        "go": lambda: Grammar({"": expand(GO_GRAMMAR)}),
    }[language]()
    return g, {g.ids[a]: g.ids[b] for a, b in _PAIRS if a in g.ids}


LEXERS = {"python": lex_python, "javascript": lex_js, "typescript": lex_js, "java": lex_java, "go": lex_go}
SUFFIXES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go"}
#: Words that are no names.
KEYWORDS = {"python": PY_KEYWORDS, "javascript": JS_RESERVED, "typescript": JS_RESERVED, "java": JAVA_RESERVED, "go": GO_RESERVED}
#: Start symbols that run over one stack; one of them must derive a file.
DIALECTS = {"python": ["File"], "javascript": ["Program"], "typescript": ["JsProgram", "Program"], "java": ["Unit"], "go": ["File"]}


def parses(language: str, lexed: Lexed) -> bool:
    """Whether a dialect of the language derives the text.  A file with nothing in it
    is no error in any language, although Go's grammar asks for a package clause."""
    if not lexed.text.strip():
        return True
    g, opens = grammar(language)
    t = Tokens([g.ids.get(k, 2) for k in lexed.kinds], lexed.nl, opens)
    return accepts(g, t, DIALECTS[language])
