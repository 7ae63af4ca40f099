"""Valid code that no rule may flag, and the same code broken."""

import pytest

from arborlake.llm.origin import evidence
from arborlake.llm.syntax import why_invalid

VALID = {
    "javascript": [
        'const a = `x ${`y ${z}`} w`;\n',
        'const o = { if: 1, class: 2, default: 3 };\n',
        'o.delete(); o.class = 1;\n',
        'label: for (;;) { break label; }\n',
        'class A { static x = 1; #p = 2; get y() { return 1 } async *g() { yield* h(); } }\n',
        'const f = async (a, b = 2, ...c) => ({ a, b });\n',
        'export default function* g() {}\n',
        'if (a) b(); else if (c) d(); else { e() }\n',
        'const r = a ? b : c ?? d;\nconst re = /ab[/]c/g.test(s);\n',
        'export const x = 1;\nexport { y, z as w } from "./a.js";\nimport d, * as q from "b";\nimport "c";\n',
        'switch (x) { case 1: case 2: y(); break; default: z(); }\n',
        'do { x++ } while (x < 3)\n',
        'const {a, b: {c = 1}, ...d} = e;\n',
        'for (const [k, v] of Object.entries(o)) f(k, v);\n',
        'try { a() } catch { b() } finally { c() }\n',
        'var x = function () { return; }\n',
        'new Foo;\nnew (bar())();\nvoid 0;\ntypeof x === "y";\n',
        'tag`a ${b} c`;\n',
        'a = b\n++c\n',
        'const o = { get, set, async, of: 1, async f() {}, get v() { return 1 }, [k]: 2, "s": 3, 4: 5 };\n',
    ],
    "typescript": [
        'type A<T> = T extends string ? { if: T } : never;\n',
        'interface A { a?: number; readonly b: string; [k: string]: unknown; m(): void; new (x: number): A }\n',
        'enum E { A = 1, B }\n',
        'declare module "x" { export function f(a: string): void; }\n',
        'abstract class A<T> extends B<T> implements C, D { constructor(private readonly a: string, public b?: number) { super(); } abstract m(): void; }\n',
        'const x = y as unknown as string[];\nconst z = y!;\n',
        'function f<T extends object>(a: T, b: keyof T): T[keyof T] { return a[b]; }\n',
        'export type { A } from "./a";\nimport type { B } from "./b";\n',
        'let x: [a: string, b?: number] = ["a"];\n',
        'function isA(x: unknown): x is string { return typeof x === "string"; }\n',
        '@Component({ a: 1 })\nclass A { @Input() x = 1; }\n',
        'const f = <T,>(x: T): T => x;\n',
        'let v = `a${`b${c}`}`;\n',
        'namespace N { export const a = 1; }\n',
        'type F = (a: number) => void;\nlet u: A | B & C;\n',
    ],
    "java": [
        'package a.b;\nimport java.util.*;\nimport static a.b.C.d;\npublic class A<T extends B & C> extends D<T> implements E, F {\n  private final int[] x = {1, 2};\n  @Override public <R> R f(Map<String, List<T>> m, int... a) throws IOException { return (R) m.get("a"); }\n}\n',
        'enum E { A(1), B(2) { void f() {} }; final int x; E(int x) { this.x = x; } }\n',
        'record P(int x, int y) { P { if (x < 0) throw new IllegalArgumentException(); } }\n',
        'interface I { default void f() { } static int g() { return 1; } int H = 1; }\n',
        'class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) { } for (var x : xs) { } int y = switch (z) { case 1 -> 2; case 3, 4 -> { yield 5; } default -> 6; }; Runnable r = () -> { }; Function<A, B> g = A::new; } }\n',
        'class A { int x = a ? b : c; String s = """\n hi\n """; char c = \'\\n\'; long l = 1L; { init(); } static { s(); } }\n',
        '@interface N { String value() default ""; int[] x() default {}; }\n',
        'class A { void f() { label: while (true) { break label; } synchronized (this) { } try (var a = b(); var c = d()) { } catch (A | B e) { } assert x : "m"; if (o instanceof String s && s.isEmpty()) { } do { } while (x); new Thread() { public void run() { } }.start(); int[][] q = new int[2][]; } }\n',
        'sealed interface S permits A, B {}\n',
    ],
    "csharp": [
        'using System;\nusing static System.Math;\nusing A = B.C;\nnamespace X.Y { public class A<T> : B, C where T : class, new() { public int P { get; private set; } = 1; public int Q => 2; private readonly List<int> l = new(); public A(int x) : base(x) { } public static A operator +(A a, A b) => a; public int this[int i] { get { return l[i]; } set { l[i] = value; } } event EventHandler E; delegate void D(int a); } }\n',
        'namespace A;\nrecord P(int X, string? Y);\nrecord struct Q { public required int Z { get; init; } }\n',
        'class A { async Task F() { await foreach (var x in y) { } var q = from a in b where a.c > 1 orderby a.d descending select new { a.e, F = 1 }; var s = $"{a} {b:C}"; var t = @"x""y"; string? n = a?.b ?? c; (int, string) tup = (1, "a"); var (d, e) = tup; switch (o) { case int i when i > 1: break; case null: default: return; } var z = o switch { 1 => "a", _ => "b" }; lock (x) { } using var u = v(); goto end; end: ; if (o is not null and { L: > 1 }) { } int[] ar = [1, 2]; x ??= y; unsafe { } checked { } } }\n',
        '[Serializable]\npublic enum E : byte { A = 1, B }\n',
        '#region a\n#if X\nclass A { ~A() { } }\n#endif\n#endregion\n',
        'Console.WriteLine("top level");\nint F(int x) => x;\n',
    ],
    "kotlin": [
        'package a.b\n\nimport a.b.c\nimport d.*\n\ndata class P(val x: Int, var y: String = "a") : B(x), C by d {\n    companion object { const val Z = 1 }\n    init { f() }\n    override fun toString(): String = "$x ${y.z("q")}"\n    val g: Int get() = 1\n}\n',
        'fun <T : Any> T.f(a: (Int) -> Unit, vararg b: Int): List<T>? where T : C { return null }\n',
        'val x = 1 foo 2\nval r = a shl 3 or b\n',
        'fun f() = when (x) { is A -> 1; in 1..2, 3 -> 2; else -> 3 }\n',
        'fun g() { for ((k, v) in m) { } val y = x?.let { it.z } ?: return; l@ while (true) { break@l }; try { } catch (e: E) { } finally { }; val o = object : I { override fun h() {} }; do { } while (x); val s = """a $b""" }\n',
        'sealed interface S\nenum class E(val a: Int) { A(1) { override fun f() {} }, B(2); abstract fun f() }\n',
        'typealias A = Map<String, (Int) -> Unit>\n@file:JvmName("x")\n',
        'inline fun <reified T> h(noinline a: () -> T) = T::class\n',
        'val z = if (a) b else c\nval l = list.filter { it > 1 }.map { x -> x * 2 }\n',
        'infix fun Int.foo(o: Int) = this + o\noperator fun A.plus(b: A): A = a\n',
    ],
    "rust": [
        'fn f() { if let Some(x) = y { } while let Some(x) = z.pop() { } let Ok(v) = w else { return; }; }\n',
        'extern "C" { fn f(x: i32) -> i32; }\nextern "C" fn g() {}\n',
        'fn f(x: u8) { match x { y @ 6 => {}, 1 | 2 => {}, 3..=5 => {}, z if z > 7 => {}, _ => unreachable!() } }\n',
        'use std::{collections::HashMap, io::{self, Read}};\nmod a;\npub(crate) mod b { pub use super::*; }\n',
        "#[derive(Debug, Clone)]\npub struct A<'a, T: B + 'a> where T: C { x: &'a T, pub y: Option<Vec<u8>> }\nstruct U;\nstruct P(i32, pub String);\n",
        'impl<T> A for B<T> { type C = D; const E: u8 = 1; fn f(&mut self, a: impl Fn(i32) -> i32) -> Result<(), Box<dyn E>> { let x = a(1)?; Ok(()) } }\n',
        'enum E { A, B(i32), C { x: u8 } }\n',
        'macro_rules! m { ($x:expr) => { $x + 1 }; }\n',
        'async fn f() { let c = |a, b| a + b; let d = move || { 1 }; g().await?; let [a, .., b] = e; let A { x, .. } = f; loop { break \'a; } \'l: for i in 0..10 { continue \'l; } let s = r#"a"b"#; let t = b"x"; let n = 1_000u64 as f32; return; }\n',
        'trait T: A + B { fn f(&self) -> Self where Self: Sized; }\nunsafe impl Send for A {}\nstatic mut X: i32 = 1;\nconst Y: &str = "a";\ntype Z = fn(i32) -> i32;\n',
        'fn main() { let x = if a { 1 } else { 2 }; let y = match z { Some(n) if n > 1 => n, _ => 0 }; println!("{}", x); vec![1, 2]; let v: Vec<_> = i.iter().map(|&x| x).collect::<Vec<_>>(); *p = 1; a..b; !x; -y; }\n',
    ],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype A struct {\n\tB\n\tc int `json:"c"`\n\td, e string\n}\n\ntype I interface {\n\tF(a int, b ...string) (int, error)\n\tJ\n}\n',
        'package a\n\nfunc (a *A) F(x, y int, f func(int) error) (n int, err error) {\n\tdefer func() { recover() }()\n\tgo f(1)\n\tfor i := range x {\n\t\tcontinue\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tif v, ok := m[k]; ok {\n\t} else if x > 1 {\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\treturn 1, nil\n}\n',
        'package a\n\nvar x = []map[string]int{{"a": 1}, {"b": 2}}\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc G[T any, U comparable](a T) U {\n\tvar u U\n\treturn u\n}\n',
        'package a\n\nfunc f() {\n\tx := &A{b: 1}\n\ty := func() {}\n\tgoto L\nL:\n\tx.y().\n\t\tz()\n\tch := make(chan<- int, 1)\n\tch <- 1\n\t*p = 2\n\ta, b = b, a\n\ts := x[1:2]\n}\n',
        'package a\n\ntype F func(a int) (b string)\ntype M map[string][]*A\n\nvar _ I = (*A)(nil)\n',
    ],
    "python": [
        'def f(a, *, b=1, **c) -> int:\n    """d"""\n    return [x async for x in y if x]\n',
        'match x:\n    case [1, *r] if r: pass\n    case {"a": b}: pass\n',
        'class A(B, metaclass=C):\n    x: int = 1\n    @p\n    def f(self): return f"{self.x!r:>{w}}"\n',
        'with open(a) as b, c: pass\ntry:\n    pass\nexcept* E as e:\n    raise X from e\n',
        'lambda x: (yield)\nx = y if z else w\nx[1:2, ...] = 3\nassert (n := 1)\n',
    ],
}
CASES = [(k, t) for k, ts in VALID.items() for t in ts]


@pytest.mark.parametrize("language,text", CASES)
def test_valid_code_is_not_flagged(language, text):
    assert why_invalid(text, language) is None


@pytest.mark.parametrize("language,text", CASES)
def test_cut_and_conflicting_code_is_flagged(language, text):
    assert why_invalid(text + "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", language)
    assert why_invalid(text + "(", language) and why_invalid(text + "}", language)


HANDWRITTEN = {
    "r/a.py": "from enum import Enum\n\nclass A(Enum):\n" + "".join(f"    X{k} = {k}\n" for k in range(5)),
    "r/t.py": "def test():\n" + "".join(f"    assert f({k}) == {k}\n" for k in range(5)),
    "r/u.py": "".join(f"path('a{k}', v{k})\n" for k in range(5)),
    "r/p.py": 'PROMPT = """' + "You are asked to write a long text about things. " * 30 + '"""\n',
    "r/a.js": "const a = (x) => { return x + 1; }; const b = (y) => { return y * 2; };\n",
}


@pytest.mark.parametrize("path", HANDWRITTEN)
def test_handwritten_files_are_kept(path):
    assert evidence(path, HANDWRITTEN[path])[0] is None


@pytest.mark.parametrize("path,text", [("r/a.min.css", "a{b:c}" * 500), ("r/a.c", "int a;" * 800)])
def test_squeezed_files_without_a_lexer_of_their_own(path, text):
    assert evidence(path, text)[0] == "minified"
