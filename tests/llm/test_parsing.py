import ast
import glob
import json
import os
import sysconfig
import tomllib

import pytest

from tesserae.llm.parsing import Checker, parse_errors, tables
from tesserae.llm.syntax.tables import Grammar, Parser, Tables

VALID = {
    "javascript": [
        "import a, { b as c } from './x';\nexport default async function* f({ a, ...r }, [b = 1] = []) { for await (const x of y) yield* x }\n",
        "const f = async (a, { b }) => ({ ...a, [b]: 1, get c() { return 1 }, async *d() {} })\nlet r = /[/\\]]+/g.test(x) ? a?.b?.[c]?.(d) : `t ${`n ${1}`} ${{ a: 1 }.a}`\n",
        "class A extends (b, c) { static #p = 1; static { this.x = 1 } get y() { return #p in this } z = () => {}\n w }\n",
        "var a = 1\nvar b = a\n++b\nif (a) b; else c\ndo x(); while (y) z()\nlabel: for (;;) { continue label }\nexport { a as default, b as 'x y' }\n",
        "a = b / c / d; x = y++ / 2; if (a) /re/.test(b)\nimport x from './d.json' with { type: 'json' }\nexport * as ns from 'y'\n",
        "/* <<<<<<< HEAD\n=======\n>>>>>>> x */ const s = '<<<<<<< HEAD'\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D, E<F> { readonly a?: string; (x: number): void; new (x: T): A<T>; [k: string]: unknown; m?<U>(u: U): asserts u is U }\n",
        "type X<T> = T extends (infer U)[] ? { -readonly [K in keyof T as `x${K}`]+?: T[K] } : typeof import('x') | unique symbol;\n",
        "export abstract class P<T> extends Q<T> implements R, S { private readonly x!: number = 1; constructor(public a: string, protected b?: T) { super() } abstract m(): void; static async *g<T>(this: P<T>, ...r: T[]): AsyncGenerator<T> {} declare y: string }\n",
        "const f = <T,>(a: T, b?: number): a is string => a as unknown as T; let v = g<string, Map<A, B<C>>>(x)!.y satisfies Z; let w = a < b && c > d;\n",
        "declare module 'x' { export function f(a: number): string }\nenum E { A = 1, B = 'x', 'c' }\nexport type { T } from './t'; import type U from './u'; import { type V } from './v';\n",
        "function f(a: string): void\nfunction f(a: any) { return a ? (b) : (c, d) => e }\n@dec({ a: 1 }) class K { @p() q: string }\nlet t: [a: string, b?: number, ...c: X[]] = null as any\nlet z = x >> 2 >>> 1 >= 3\n",
    ],
    "rust": [
        "#![allow(x)]\nuse a::{self, b::*, c as d};\npub(crate) fn f<'a, T: A + ?Sized, const N: usize>(&'a mut self, (x, _): (u8, &[T; N])) -> impl Fn(&T) -> Vec<Vec<u8>> + 'a where T: for<'b> F<'b, Item = u8> { let y = x.0.1 as u8 << 2; move |z| vec![y; 3].into_iter().map(|q| q + z).collect::<Vec<_>>() }\n",
        "impl<T> A<T> for B { type X = T; const C: [u8; 2] = [1, 0x_ff]; fn g(self: Box<Self>) -> Result<(), E> { match self { Self::A { a, ref b, .. } if a > 1 => {} A(1..=5 | 7, ..) => return Ok(()), 'a'..='z' => (), _ => panic!(\"{}\", r#\"x\"y\"#) } if let Some(x) = y && z { x } else { w }?; Ok(()) } }\n",
        "macro_rules! m { ($($x:expr),* $(,)?) => { $( f($x); )* }; }\nstruct S(pub u8, #[a] String);\nenum E { A = 1, B { x: u8 }, C(u8) }\nunsafe extern \"C\" { fn x(a: *const u8, ...); }\n/* a /* nested */ b */ static mut X: &'static dyn Fn() = &|| ();\n",
        "async fn a() { 'l: loop { break 'l S { a: 1, ..b } } let x = if a == b { 1 } else { 2 }; for i in 0.. { x.await?; } while x < y { } *z = -1; let Some(q) = r else { return }; (|a: u8| -> u8 { a })(1) }\n",
    ],
}
BROKEN = {
    "javascript": ["{\"a\": 1}", "let a = {b: 1;", "function f(a: number) {}", "def f(): pass", "const a = 'x\n';", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "f(1, 2", "}", "x = `a ${b", "if (a {", "let = = 2", "/* a", "<!DOCTYPE html>\n<html></html>"],
    "typescript": ["interface A { a: }", "let a: = 1", "function f(a: string { }", "class A { b(: void {} }", "type X = ", "import { a from 'b'", "const x = y as ;", "a ||||||| b"],
    "rust": ["fn f() { let x = ; }", "fn f( { }", "struct A { b u8 }", "fn f() -> { }", "let x = 1;", "fn f() { 'x }", "fn f() { a(] }", "pub fn", "fn a() { \"x }", "{\n  \"a\": 1\n}\n"],
    "python": ["def f(:\n  pass", "x = (1", "if a\n  b", "  x = 1\ny = 2", "def f():\nx", "a b", "'x", "class", "x = 08", "<<<<<<< HEAD\n", "f(a for", "import { a } from 'b'"],
}


@pytest.fixture(scope="module")
def check():
    return {name: Checker(name, tables(name)).error for name in ("python", "javascript", "typescript", "rust", "json", "toml")}


def test_tables_of_small_grammars():
    t = Tables(Grammar("%left '+'\n%left '*'\ne : e '+' e | e '*' e | '(' e ')' | ID ;", "e"))
    n = t.terminal
    assert t.conflicts == 0
    assert Parser(t).error([n["ID"], n["'+'"], n["ID"], n["'*'"], n["'('"], n["ID"], n["')'"], 0]) is None
    assert Parser(t).error([n["ID"], n["'+'"], n["')'"], 0]) == 2
    # needs both readings for an unbounded stretch: a palindrome of x with a mark in the end
    t = Tables(Grammar("s : a 'y' | b 'z' ;\na : 'x' | a 'x' ;\nb : 'x' | b 'x' ;", "s"))
    n = t.terminal
    for end in ("'y'", "'z'"):
        assert Parser(t).error([n["'x'"]] * 9 + [n[end], 0]) is None
    assert Parser(t).error([n["'x'"]] * 9 + [0]) == 9


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(check, language, text):
    at = check[language](text)
    assert at is None, text[max(0, at - 40) : at] + " <HERE> " + text[at : at + 30]


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(check, language, text):
    assert check[language](text) is not None


def test_python_agrees_with_the_interpreter(check):
    files = sorted(glob.glob(os.path.join(sysconfig.get_paths()["stdlib"], "*.py")))[:60]
    for f in files:
        with open(f, encoding="utf-8") as h:
            text = h.read()
        raw = Checker("python", tables("python"))
        raw.language = "other"  # without the confirmation
        assert raw.error(text) is None, f
        ast.parse(text)


def test_data_formats(check):
    for t in ["{}", "[1, -2.5e3, \"\\u00e9\", {\"a\": null}]", "01", "[1,]", "{a: 1}", "NaN", "'a'", "\"a\nb\"", "[1] 2", "// c\n1", "", " ", "{\"a\":1,\"a\":2}", "1.", "\"\\x\"", "tru", "true false"]:
        try:
            json.loads(t, parse_constant=lambda _: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (check["json"](t) is None) == ok, t
    for t in ["a = 1\n[b.c]\nd = [1, 2,\n 3, # x\n]\ne = {f = 'x', \"g h\".i = 1979-05-27T07:32:00Z}\n[[j]]\n", "a = ", "a = 1 b = 2", "[a", "a = 'x", "a = 01", "a: 1", "\"x\"\n", "a = [1 2]", "a = {b = 1,}", "k = \"\"\"x\ny\"\"\"", "= 1", "a.b = inf", "a = 0x", "3.14 = 'pi'", "a = 1__0", "{\n}"]:
        try:
            tomllib.loads(t)
            ok = True
        except tomllib.TOMLDecodeError:
            ok = False
        assert (check["toml"](t) is None) == ok, t


def test_table(spark):
    rows = [(1, "a/b.py", "x = 1\n"), (2, "b.py", "x = 1\ny = (\n"), (3, "c.json", "{"), (4, "d.md", "{"), (5, "e.py", None), (6, "f.py", ""), (7, None, "("), (8, "g.d/h", "("), (9, ".json", "[]"), (2, "b.py", "x = 1\ny = (\n"), (None, "z.json", "]"), (10, "x.ts", "let a = 1;\n" * 20_000 + "let")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, new_content string, language_name string")
    got = parse_errors(df, "id", "path", "new_content", {"py": "python", "json": "json", "ts": "typescript"}).collect()
    assert sorted(((r.id or 0, r.language_name, r.error_line) for r in got), key=str) == sorted([(1, "python", None), (2, "python", 3), (2, "python", 3), (3, "json", 1), (9, "json", None), (0, "json", 1), (10, "typescript", 20_001)], key=str)
    assert parse_errors(df.limit(0), "id", "path", "new_content", {"py": "python"}).count() == 0
