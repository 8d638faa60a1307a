"""Parsers against the interpreter's own (Python, JSON) and by hand-made cases; broken files are broken ones of valid files."""

import ast
import json
import os
import random
import sysconfig

import pytest

from loomgraph.llm.peg import Grammar
from loomgraph.llm.syntax import LANGUAGES, first_error, invalid, judged, rates

VALID = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    return [y for y in c if y]\n", "async def g():\n    async with a as b, c:\n        await b\n", "match p:\n    case [1, *r] if r: pass\n    case {'a': x, **y} | P(z=1): pass\n    case _: pass\n", "match = 1\nmatch.case(2)\n", "x: int = (yield)\n", "f'{a!r:>{w}} {b[\"k\"]}'\n", "try:\n  pass\nexcept* E as e:\n  pass\nelse:\n  pass\n", "with (open(a) as b, open(c)):\n    pass\n", "lambda *a, k=1, **b: (a, b)\n", "a = b = c, *d = e\n", "x[1:2, ..., ::3] = {**a, 'b': 1}\n", "@a.b(c)\nclass D(E, metaclass=F): x = 1; y = 2\n", "if (n := len(a)) > 1: pass\nelif b: pass\nelse: pass\n", "type X[T: int] = list[T]\n", "print(*a, **b, c=1)\n", "0xFF + 1_000 + 1e5j + .5\n", "def f():\n\tif x:\n\t\tpass\n\treturn\n", "a if b else c\nnot a in b\na is not b\n", "raise E from None\nglobal x, y\ndel a, b[0]\nassert a, b\n", "from . import (a as b, c,)\nfrom ..x import *\nimport a.b as c, d\n"],
    "json": ["{}", "[]", "1", '"a\\u00e9\\n"', ' {"a": [1, -2.5e+3, true, null, {"b": {}}]} '],
    "javascript": ["", "a = b\n(c)\n", "let x = 1\nlet y = 2", "const f = async ({a, b: [c] = []}, ...d) => { await c; }", "class A extends B { static #p = 1; get x() { return this.#p } static { } async *g() { yield* a } }", "for (const [k, v] of m) ;\nfor (var i = 0; i < 3; i++) {}\nfor (x in y) z()", "x = a ? b : c => d", "`a ${`b ${c}`} d`", "re = /[/\"]+\\//gi.test(x)", "a?.b?.[c]?.(d) ?? e", "import a, {b as c} from 'x'; export default class {}; export * as n from 'y'", "label: while (1) { break label }", "do x++; while (x < 5)\ny", "var {a = 1, ...r} = o, [b,, c] = d", "!function(){}()", "return_ = {get, set, async, of, 'a b': 1, [c]: 2, d() {}, get e() { return 1 }}", "if (a) b; else if (c) d\nelse { e }", "try { a } catch { b } finally { c }", "x = y => ({}), z", "new.target; new A; new (f())(1)", "switch (a) { case 1: b; break; default: c }", "'use strict'\nvar o = {if: 1}.if", "a\n++b", "x = a / b / c", "import('x').then(y)", "async () => { for await (const x of y) {} }"],
    "typescript": ["interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: number; m<U>(x: U): void; new (a: B): C }", "type U = A | (B & C)[] | { [K in keyof T]?: T[K] } | `x${string}` | (new () => D) | ((a: B, ...c: D[]) => void)", "export const f = <T,>(a: T, b?: U): a is T => b as any", "enum E { A = 1, B }\ndeclare module 'x' { export function f(a: number): void }", "abstract class A<T> implements B { constructor(private readonly a: string, public b?: number) { super() } abstract m(): void; protected x!: T }", "let x: typeof y['z'] = <A>b!;", "function f(this: A, ...b: C<D>[]): asserts b is E {}", "const x = a < b && c > d; f<T>(y); new Map<string, Array<number>>()", "namespace N.M { const a = 1 }\nimport x = require('y')\nexport = z", "type X = A extends infer B ? B : never; let t: [a: string, b?: number, ...c: D[]]", "export type { A } from 'b'; import type { C } from 'd'; x satisfies Y", "@Dec() class A { @Input() b: string; get c(): D { return 1 } }", "const hit = (a: Map<string, B>): B | undefined => { return a.get('x') as B }"],
    "go": ["", "package a\n", "package a\nimport (\n\t\"fmt\"\n\tb \"c\"\n)\nfunc f[T any, U ~int | string](a, b int, c ...T) (x int, err error) {\n\tif v, ok := m[a]; ok && v == (T{}) {\n\t\treturn\n\t}\n\tfor i, x := range []int{1, 2} {\n\t\tgo func() { <-c }()\n\t}\n\tswitch t := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n}\n", "package a\ntype (\n\tA struct {\n\t\tB\n\t\t*c.D `json:\"x\"`\n\t\te, f map[string][]func(int) chan<- bool\n\t}\n\tI interface {\n\t\tM(a int) error\n\t\t~int | string\n\t}\n)\nconst (\n\tx = iota\n\ty\n)\nvar z = &A{e: nil, f: map[string]int{\"a\": 1}}\n", "package a\nfunc (r *R[T]) M() { x.y(z...)[1:2].w = `raw\n`; L: for { break L }; for i := 0; i < n; i++ { defer f(i) } }"],
    "java": ["", "package a.b; import static c.D.*; @A(b = {1, 2}) public final class E<T extends F & G> extends H<T[]> implements I, J { private static final int[] x = {1, 2,}; static { } E(int a, String... b) throws C { this(a); } <U> List<? super U> m(final Map<String, List<U>> p) { for (int i = 0, j = 1; i < 3; i++) ; for (var q : p.keySet()) { } return x -> y::z; } }", "record P(int a, String b) implements C { P { } } sealed interface S permits A, B { default void m() { } } enum E { A(1) { void f() {} }, B; int x; }", "class A { Object f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case String s -> { yield 1; } default -> throw new E(); }; } String t = \"\"\"\n a \"q\" \n\"\"\"; int g() { try (var r = new R(); s) { } catch (A | B e) { } finally { } int[][] a = new int[3][]; return (int) (a[0])[1] + (String) b + (c) - d; } }", "@interface X { int a() default 1; String[] b() default {}; } interface Y { void m(); }", "class A { char c = '{'; long n = 0xFFL + 1_000 + 1e3f; boolean b = a < c && d > e || x instanceof List<?> l; Runnable r = () -> { label: while (true) { continue label; } }; int v = a >>> 2 >> 1; Class<?> k = int[].class; }"],
    "rust": ["", "use std::{collections::HashMap, io::{self, *}};\n#[derive(Debug)]\npub struct A<'a, T: ?Sized + 'a> where T: Fn(i32) -> u8 { pub(crate) x: &'a mut T, y: [u8; 4] }\nenum B { C(u8), D { e: i32 }, F = 3 }\ntype G = Box<dyn Fn(&str) -> Result<(), Box<dyn E>> + Send>;", "fn f<T>(a: &[i64], mut b: T) -> Option<Vec<Vec<i32>>> {\n let x = if a.len() > 1 { 2 } else { 3 };\n match x { 1 | 2 if a == b => {}, 3..=9 => return None, Some(ref y) | P { y, .. } => y?, _ => unreachable!(\"{{\") }\n for (i, v) in a.iter().enumerate() { s += *v as i64 << 2; }\n while let Some(z) = it.next() { break 'l; }\n let c = move |x: i32, _| -> i32 { x + 1 };\n Ok(c(1).await?.d::<u8>()[0])\n}", "impl<T> Tr for A<T> { const X: i32 = 1; type Y = Z; fn m(&mut self, n: usize) -> Self { Self { n, ..self } } }\nmacro_rules! m { ($a:expr) => { $a }; }\nm! { x }\nmod t { #![allow(x)] }\nunsafe extern \"C\" fn g() {}", "/* a /* nested */ b */ fn f() { let s = r#\"raw \" \"#; let c = '{'; let l: &'static str = \"\"; let n = 1_000u64 + 0xffi32 as u8; let r = 1..; x[..2]; }", "trait A: B + C { fn f(&self) -> impl Fn() -> u8 where Self: Sized; fn g() {} }\nstatic X: &[&str] = &[\"a\"];\nasync fn h() { let v = vec![1; 3]; loop { if a { continue } } }"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n  (a)\nstruct s { int a : 3; struct { union { char b; } u; } c; } *p, q = { .a = 1, .c = { 0 } };\ntypedef unsigned long int (*fp)(const char *, ...);\nenum e { A, B = 2, };", "static inline int f(int n, char *a[], size_t x) { int i, t = 0; for (i = 0; i < n; i++) { if (a[i] != 0 && *a[i] != '{') t += sizeof(struct s) * (int)x; else goto end; } switch (t) { case 1: case 'a': break; default: return -t; } do { t--; } while (t > 0); end: return t ? t : x ^ 19L; }", "long g(struct b *p, long s) { return p->q.r(s << 2, (char)1)[3]++; } extern int h(void); int (*k)(int) = 0; const char *t = \"a\" \"b\";", "#if A\nint f(int a) {\n#else\nint f(void) {\n#endif\n return 0;\n}\n", "uint32_t x = 0xFFu; FILE *f; my_t a, *b = &a; void v(my_t (*cb)(void), int m[static 3]) { my_t *c = (my_t *)b; a * d; c = (struct s){ 1, 2 }; }"],
}
BROKEN = {
    "python": ["def f(:\n", "x = (1\n", "  x = 1\n", "if a:\nb\n", "<<<<<<< HEAD\nx = 1\n=======\n", "a = 1abc\n", "print 'x'\n", "f(a=1, 2)\n", "def f(a=1, b): pass\n", "x = 'abc\n", "class:\n", "f() = 1\n", "return = 1\n", "if x:\n\tpass\n        pass\n", "a b\n", "for x in y\n  pass\n", "package main\n", "{'a': }\n", "x = 08\n", "else:\n  pass\n"],
    "json": ["", "{", "[1,]", "{'a': 1}", "{a: 1}", "01", "[1] 2", "NaN", '"a\nb"', "// c\n{}", "{\"a\": 1,}", "tru", "1.", '"\\x"', "\u00a0{}"],
    "javascript": ["{", "let x = ;", "function () {}", "a b", "if (", "class { }", "const f = (a: string) => a", "`${a`", "import x from", "<!DOCTYPE html>", "<<<<<<< HEAD\na()\n", "x = {a: 1, b}}", "var 1a", "for (;;", "package main", "return }", "a => { ", "/* open", "use std::x;"],
    "typescript": ["interface A { b: }", "type = 1 2", "let x: string = ;", "function f(a: ) {}", "package a\n", "enum { A }", "class A { constructor(private) }}"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "package a\nvar x int = \n", "package a\nfunc f()\n{\n}\n", "package a\nimport fmt\n", "package a\nif x {}\n", "package a\n<<<<<<< H\n", "class A {}\n", " "],
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { return 1 } }", "package a", "public int x;;;}", "class A { void f( { } }", "def f(): pass", "class A { int f() { if (a { } } }", "import a.*", "class A { <<<<<<< H\n }"],
    "rust": ["fn f() {", "fn f( {}", "struct A { x }", "let x = 1;", "fn f() { let = 2; }", "fn f() -> { }", "use a::;", "fn f() { match x { 1 => } }", "fn f() { a(1 }", "def f(): pass", "fn f() { /* open }"],
    "c": ["int f() {", "int f( { }", "int x = ;", "struct s { int a }", "return 1;", "int f() { if a { } }", "int f() { return x + ; }", "}", "int f() { <<<<<<< H\n }", "int a[3;"],
}


@pytest.mark.parametrize("name", LANGUAGES)
def test_valid(name):
    for text in VALID[name]:
        assert first_error(name, text.encode()) == -1, text
        if "\n" in text and name != "json":
            assert first_error(name, text.replace("\n", "\r\n").encode()) == -1, text


@pytest.mark.parametrize("name", LANGUAGES)
def test_broken(name):
    for text in BROKEN[name]:
        assert first_error(name, text.encode()) >= 0, text
    assert first_error(name, b"\xff\xfe\x00") >= 0


def python_ok(text):
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def test_python_against_the_interpreter():
    """Files of the standard library, as they are and broken at random places."""
    r, seen = random.Random(1), 0
    folder = sysconfig.get_paths()["stdlib"]
    for name in sorted(os.listdir(folder))[:70]:
        if not name.endswith(".py"):
            continue
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            text = f.read()
        assert (first_error("python", text.encode()) < 0) == python_ok(text), name
        lines = text.splitlines(keepends=True)
        start = r.randrange(len(lines))
        part = "".join(lines[start : start + 40])
        for broken in (part, text[: r.randrange(len(text))][-1500:], part.replace(")", "", 1), part.replace(":", "", 1)):
            seen += 1
            assert (first_error("python", broken.encode()) < 0) == python_ok(broken), broken
    assert seen > 100


def test_json_against_the_library():
    r = random.Random(2)
    base = json.dumps({"a": [1, 2.5, None, True], "b": {"c": "x\n\u00e9"}, "d": []}, indent=1)
    for _ in range(600):
        i = r.randrange(len(base))
        text = r.choice([base[:i], base[i:], base[:i] + r.choice('{}[],:"0e- x') + base[i:], base[:i] + base[i + 1 :]])
        try:
            json.loads(text, parse_constant=lambda x: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (first_error("json", text.encode()) < 0) == ok, text


def test_grammars_by_hand():
    g = Grammar("Start <- Sum END\nSum <- Term (('+' / '-') Term)*\nTerm <- NUMBER / '(' Sum ')'\n")
    k = g.kinds
    tokens = lambda s: [k.get(c, k["NUMBER"]) if c != "$" else k["END"] for c in s + "$"]
    assert g.parse(tokens("1+(2-3)"), [False] * 9) == -1 and g.parse(tokens("1+"), [False] * 9) == 2 and g.parse(tokens("(1"), [False] * 9) == 2
    with pytest.raises(ValueError):
        Grammar("Start <- nope")


def test_deep_and_large():
    assert first_error("json", ("[" * 3000 + "]" * 3000).encode()) == -1
    assert first_error("json", ("[" * 300_000 + "]" * 300_000).encode()) == 0
    assert first_error("javascript", ("x = " + "(" * 400 + "1" + ")" * 400).encode()) == -1
    assert first_error("c", ("int f() { return " + " + ".join(["a"] * 20000) + "; }").encode()) == -1


def test_files(spark):
    rows = [("r/a.py", "r", "py", b"x = 1\n"), ("r/b.py", "r", "py", b"\n\nx = (\n"), ("r/b.py", "r", "py", b"\n\nx = (\n"), ("q/c.json", "q", "json", b""), ("q/d.py", "q", "py", b""), ("q/e.py", "q", "py", None), (None, "q", "py", b"("), ("q/f.txt", "q", "txt", b"("), ("q/g.py", "q", "py", b"\xff")]
    df = spark.createDataFrame(rows, "path string, repo string, ext string, content binary")
    languages = {"py": "python", "json": "json"}
    assert {tuple(r) for r in invalid(df, languages).collect()} == {("r/b.py", "python", 4), ("q/c.json", "json", 1), ("q/g.py", "python", 1)}
    assert {tuple(r) for r in rates(df, languages).collect()} == {("r", "python", 2, 1, 0.5), ("q", "json", 1, 1, 1.0), ("q", "python", 2, 1, 0.5)}
    assert judged(df.limit(0), languages).count() == 0
    with pytest.raises(ValueError):
        judged(df, {"x": "cobol"})
