import ast
import warnings

import pytest

from lodestone.llm import gll
from lodestone.llm.languages import LEXERS, parses


def ok(language, text):
    return parses(language, LEXERS[language](text))


GOOD = {
    "python": [
        "", "\ufeffx = 1\r\n", "if x:\n\ty = 1\n\tz = 2", "def f(a, /, b: int = 1, *c, d, **e) -> str:\r    return [x async for x in y if z]\r",
        "class A(B, metaclass=C):\n    x: int = 3\n    @d.e(1)\n    async def f(self): await g()\n", "match a:\n    case [1, *_] if b:\n        pass\n    case {'k': v, **r} | C(x=1):\n        pass\n",
        "match = 1\ntype = match\nprint(match, type)\n", "x = lambda *a, k=1: (yield)\nwith (open(a) as b, c): pass\nfor a, *b in c: d[1:2, ::3] += 1\nelse: pass\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a, b[0]\n", "f(a, *b, c=1, **d)[x := 1] @ ~y if not z in w else -1\n'''\n<<<<<<< ours\n'''\n",
    ],
    "javascript": [
        "", "let a = 1\nlet b = 2", "const f = async (a, {b, c: [d] = []}, ...e) => ({...a, [b]: c, get x() { return 1 }, async *g() {}})", "x = a ? b : c => d;\n/re[/]x/g.test(y) && z",
        "import a, {b as c, default as d} from './e'\nexport default class extends A { static #p = 1; static { x() } get v() { return this.#p } async *m() { yield* 1 } }",
        "for (const [a, b] of c) continue\nfor (let i = 0, n = 9; i < n; i++) { if (i) break; else { } }\nfor await (x of y) {}", "`a${`b${c}`}d` + tag`x`\nlabel: while (1) { break label }\nvar y = a / b / c",
        "function f() { return\n1 }\ndo x++\nwhile (y)\nz()", "!function(x){x['a']=function(r){for(var i=0;i<r;i++)x.s+=i;return x};}({});", "a?.b?.[c]?.(d) ?? new E.F(g).h, new.target\nimport('x').then(y)",
        "export const a = 1, b = 2\nexport * as c from 'd'\nexport { e as default }\ntry { } catch { } finally { }\nswitch (a) { case 1: b; default: c }",
    ],
    "typescript": [
        "const f = <T extends object = {}>(a: T, b?: string, ...c: number[]): a is string => true", "export abstract class A<T> extends B<T> implements C, D { private readonly x?: number = 1; constructor(public a: string, @Dec() b) { super() } abstract m(): void; static async g<K>(): Promise<Map<string, Array<K>>> { } [k: string]: any }",
        "interface A extends B<C> { (x: number): string; new (y: T): Z; readonly a?: B['c'][]; m<T>(): void }\ntype X<T> = { readonly [K in keyof T]?: T[K] } | (T extends infer U ? [a: U, ...b: V[]] : never) & `a${string}`",
        "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.M { let a }\nlet z = a as unknown as B<C>;\nlet w = x!.y!\nfunction f(this: A): asserts x is B;\nfunction f() {}", "let a = b < c, d = e > f\nlet g = h<i>(j)\nlet x = a >> b >>> c >= d", "function plain(a) { return a }",
    ],
    "java": [
        "", "package a.b; import static c.D.*; @A(x = 1, y = {2, 3}) public final class E<T extends F & G> extends H<T[]> implements I, J { static { } int a[] = {1}, b; E() { this(1); } <K> Map<K, List<? super T>> m(final int... x) throws Y { return (a, b) -> a::b; } }",
        "sealed interface S permits A, B {}\nrecord A(int x, String... y) implements S { A { if (x < 0) throw new X(); } }\nenum E { P(1) { void f() {} }, Q; int z; }\n@interface N { int v() default 1; }",
        "class A { void f() { var x = switch (y) { case 1, 2 -> { yield 3; } default -> 4; }; for (int i = 0, j = 1; i < j; i++, j--) ; for (var a : b) { } try (var r = s()) { } catch (A | B e) { } finally { } if (o instanceof String s && !s.isEmpty()) lab: do { continue lab; } while (true); int[] q = new int[3]; List<String>[] l = (List<String>[]) new List[2]; String t = \"\"\"\n  a \"b\"\n  \"\"\"; synchronized (this) { assert x > 1 : \"m\"; } new Thread() { public void run() { } }.start(); Runnable z = () -> { }; Supplier<A> n = A::new; x = y >> 2 >>> 1; } }",
    ],
    "go": [
        "", "package a\n\nimport (\n\t\"fmt\"\n\t. \"x\"\n\t_ \"y\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, b int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(x int) (y string, err error)\n\t~int | string\n}\n",
        "package a\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v != nil {\n\t\treturn\n\t} else if x := f(); x {\n\t}\n\tfor i := range n {\n\t}\n\tfor k, v := range m {\n\t\tcontinue\n\t}\n\tfor {\n\t\tselect {\n\t\tcase c <- 1:\n\t\tcase x := <-d:\n\t\tdefault:\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tdefer func() { recover() }()\n\tgo g(a...)\n\tx, y = y, x\n\tp := &T{A: 1, B: []int{1, 2}, C: {3}}\n\tq := map[string][]int{\"a\": {1}}\n\tr := s[1:2:3]\n\tch := make(chan<- int, 3)\nL:\n\tfor ; i < 3; i++ {\n\t\tbreak L\n\t}\n\treturn 1, nil\n}\n",
        "package a\nconst (\n\tA = iota\n\tB\n)\nvar x, y = 1, 'c'\nvar z [3]int\nvar f = func(a int) bool { return a == T{}.x }\n",
    ],
}
BAD = {
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "  x = 1\n", "x = 'a\n", '"""abc', "print 'x'\n", "a b\n", "if x:\n        y\n    z\n", "f(x) = 1\n", "<<<<<<< HEAD\nx = 1\n", "x = (1\n", "1 = x\n", "if x:\n\ty = 1\n        z = 1\n", "x = 5xs4\n", "else:\n    pass\n"],
    "javascript": ["let x: number = 1", "function f( { }", "a b", "class A { m() }", "return 1", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "x = `a", "'a", "if (x", "let = 1", "interface A {}", "--- 8< --- 31 lines\n", "[... 5 lines omitted ...]\n", "const x;", "}", "def f(): pass"],
    "typescript": ["let x: = 1", "class A { m(: string) {} }", "type A = ;", "package a\nfunc f() int64 { return 1 }", "<html></html>", "enum { A }"],
    "java": ["class A { void f() { x + 1; } }", "class A { void f() { long lev } }", "function f(a) { return a; }", "class A {", "public void f() {}", "import a.b", "class A { f(a) { } }", "class A { String s = \"a; }"],
    "go": ["package a\nfunc f() {\n\tx := \n}\n", "x := 1\n", "package a\nfunc f()\n{\n}\n", "package a\nif x {\n}\n", "package a\nvar x = \"a\n", "package a\nfunc f() {\n\tif x == T{} {\n\t}\n}\n", "package a\n... (3 more lines)\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepts(language):
    assert [t for t in GOOD[language] if not ok(language, t)] == []


@pytest.mark.parametrize("language", BAD)
def test_rejects(language):
    assert [t for t in BAD[language] if ok(language, t)] == []


def test_all_javascript_is_typescript():
    assert [t for t in GOOD["javascript"] if not ok("typescript", t)] == []


def test_python_as_its_own_parser(data):
    import duckdb

    rows = duckdb.sql(f"SELECT content FROM '{data}/../sf0.01/file_texts.parquet' JOIN (SELECT DISTINCT node_id, file_path FROM '{data}/../sf0.01/file_nodes.parquet') USING (node_id) WHERE lower(file_path) LIKE '%.py' AND content IS NOT NULL").fetchall()
    assert rows
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for (t,) in rows:
            try:
                ast.parse(t.removeprefix("\ufeff"))
                good = True
            except SyntaxError:
                good = False
            assert ok("python", t) == good


def test_recogniser_takes_left_recursion_and_ambiguity():
    g = gll.Grammar({"": "S = E EOF\nE = E '+' E | 'x'"})
    toks = lambda s: gll.Tokens([g.ids.get(c, 2) for c in s] + [1], [False] * (len(s) + 1), {})
    assert gll.accepts(g, toks("x+x+x+x+x"), ["S"]) and not gll.accepts(g, toks("x+x+"), ["S"]) and not gll.accepts(g, toks(""), ["S"])


def test_deep_and_long_texts():
    assert ok("python", "x = " + "(" * 3000 + ")" * 3000 + "\n") and not ok("javascript", "(" * 5000)
    assert ok("javascript", "f(1);\n" * 20000)


# ---------------------------------------------------------------- finer points of the languages
INVALID = {
    "python": [
        'def f(a=1, b): pass',
        'def f(*): pass',
        'x = 08',
        'x = f"{a b}"',
        "x = f'{'",
        'f(x for x in y, 1)',
        'f(**k, *a)',
        'f(a=1, b)',
        'x = y := 1',
        'y := 1',
        '(*a)',
        'del *a',
        'x = b"é"',
        'x = "\\x1"',
        'lambda a=1, b: a',
        'def f(a, /, b, /): pass',
        'def f(**k, a): pass',
        'x = f"}"',
        'x = f"{}"',
        'x = f"{a!}"',
        'x = "a" b"c"',
        'try: pass\nexcept a: pass\nexcept* b: pass\n',
    ],
    'javascript': [
        '1 = x;',
        'f() = 1',
        'if (x) f(y) = 1',
        'g(x)(y) = 1',
        'a ?? b || c',
        'x = "\\x1"',
        'this = 1',
        'a?.b = 1',
        '1++',
        '++f()',
        'x = 08',
    ],
    'typescript': [
        '1 = x;',
        'f() = 1',
    ],
    'java': [
        'class A { void f() { 1 = x; } }',
        'class A { void f() { f() = 1; } }',
        'class A { int x = 08; }',
        'class A { String s = "\\q"; }',
        'class A { void f() { this = 1; } }',
    ],
    'go': [
        'package p\nfunc f() { a, b++ }',
        'package p\nfunc f(a int, string) {}',
        'package p\nvar x = 08',
        'package p\nvar x = "\\q"',
        'package p\nfunc f() { a, b }',
        'package p\nfunc f() { a.b := 1 }',
        'package p\nfunc f() { a, b += 1, 2 }',
    ],
}

VALID = {
    "python": [
        'def f(a, b=1, *, c, d=2, **k): pass',
        'def f(a, /, b, *args: int, **k): pass',
        'def f(*, a): pass',
        'def f(*a, b=1,): pass',
        'x = 0_0',
        'x = 00',
        'x = 08.5',
        'x = 1_0e5j',
        'x = f"{a!r:>{w}} {b=} {{}} {c[\'k\']}"',
        'x = f"{x["a"]}"',
        'x = f"{a:%H:%M}"',
        "x = f'''{\na\n}'''",
        'f(a, *b, c=1, **k)',
        'f(a=1, *b)',
        'x: int = lambda a=1: a',
        'lambda a=1: a',
        'lambda *, a: a',
        'x = (y := 1)',
        '(a, *b)',
        'x = rf"\\{a}\\d"',
        'x = f"\\N{DASH}{a}"',
        'x = f"{a:{b}{c}}"',
        'x = f"{lambda_}"',
        'match x:\n    case {"a": 1, **r}: pass\n    case P(x=0, y=[a, *_]) | -1: pass\n    case a.b | "s" if z: pass\n    case 1, *r: pass\n',
        'x = f"{a}" "b" f"{c}"',
        'f"{x!r}"',
        'f"{d[\'a\']:>{10}}"',
        'f"{{}}{x}}}"',
        'x = f"{a if b else c}"',
        'x = f"{ {1:2}[1] }"',
        "x = f'{a:\\n}'",
        'a = b = c',
        'a += yield',
        'print(f"{x:,}")',
        'f"{(lambda x: 1)(2)}"',
        'f"{x:=5}"',
        'f"{a!=b}"',
        'f""" "{a}" """',
    ],
    'javascript': [
        'a.b = 1',
        '(a) = 1',
        '[a,b] = c',
        '({a} = b)',
        'a[0] += 1',
        'f().x = 1',
        'f()[0]++',
        '++a.b',
        'a ?? b ?? c',
        '(a ?? b) || c',
        'a && b || c',
        'x = "\\u{1F600}\\x41\\0"',
        'for (a.b of c) {}',
        'for (const [a,b] of c) {}',
        'a = b = c',
        'return_ = function(){ return (a) = 1 }',
        'let x = 1, y = `${a}b`',
        'x = a?.b',
        'x++\ny--',
        '`${a}` + f`x`',
        'if (a) b = 1; else c = 2',
        'a.this = 1',
        'while (x) (y) = 1',
        'if (f(x)) (y).z++; else (w) = 2',
    ],
    'typescript': [
        'a! = 1',
        '(a as any) = 1',
        'let x = <any>y',
        'x = y as const',
        '(<any>a).b = 1',
    ],
    'java': [
        'class A { void f() { a.b = 1; a[0]++; ++x; x--; f().y = 2; (a) = 1; this.x = 3; int y = a = 5; } }',
        'class A { double d = 08.5, e = 1e5, f = 0x1F, g = 017, h = 1_000L, i = 0f; }',
        'class A { String s = "\\n\\t\\"\\u0041\\\\d\\0"; char c = \'\\\'\'; }',
        'class A { void f() { int i = (x)++ ; } }',
    ],
    'go': [
        'package p\nfunc f(a, b int, c ...string) (x int, err error) { a, b = b, a; a++; c <- 1; x := 1; for i, v := range x {}; for a[0], b = range c {}; a += 1 }',
        'package p\nfunc f(int, ...string) (int, error)',
        'package p\nvar x = 0o17 + 017 + 08.5 + 1e5 + 09i + 0x1p-2',
        'package p\nvar s = "\\n\\x41\\u1234\\\\"',
        'package p\nfunc f(func(int) error, map[string]int, []a, *b)',
    ],
}


@pytest.mark.parametrize("language", INVALID)
def test_finer_points(language):
    assert [t for t in INVALID[language] if ok(language, t)] == [] and [t for t in VALID[language] if not ok(language, t + "\n")] == []


STATEMENTS = [
    "a, *b = c if d else e, not f is not g not in h", "x: int = lambda *a, k=1, **w: (a, k)", "print(f\"{a!r:>{w}} {b=} {{}} {c['k']}\", *z, sep='', **k)", "def f(a, /, b=1, *c, d, **e) -> int: pass",
    "x[i:j, ::k, *l] = i ** -j @ k // m", "y = {**a, 'b': 1, **{c: d for c, d in e.items()}}, {1, *s}, [*a, (yield)]", "with (a as b, c): pass", "from . import (a, b as c,)", "assert (n := f(a=1, *b)) and True, 'x'",
    "match x:\n    case [1, *_] | {'a': b, **c} if d: pass\n    case P(0, y=-1.5) as p: pass", "try: pass\nexcept (A, B) as e: raise E from None\nelse: del a[0], b.c\nfinally: global g", "s = rb'q' b\"x\"; u = 0x_f + 1_0.5e-3j + .5 + 0 if 1if a else 2",
]
PARTS = "* ** , = := : ( ) [ ] { } lambda yield await not in is if else for async def / -> ... @ 1 08 'a' f'{a}' b'x' None ; . as from import x case match _ != ~ -".split()


def test_changed_python_as_its_own_parser():
    """Statements with parts taken out, put in and swapped: the verdict is that of Python's own parser."""
    import random
    import re

    r, wrong, good = random.Random(3), [], 0
    for _ in range(3000):
        parts = re.findall(r"\w+|\s+|\S", r.choice(STATEMENTS) + "\n")
        for _ in range(r.randrange(1, 4)):
            i = r.randrange(len(parts))
            parts[i : i + r.randrange(2)] = r.choice(([], [r.choice(PARTS)], [" " + r.choice(PARTS) + " "], [parts[r.randrange(len(parts))]])) or [""]
        text = "".join(parts)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
        good += valid
        if ok("python", text) != valid:
            wrong.append(text)
    assert wrong == [] and 100 < good < 2900
