"""Declarations and facts of source text: hand-derived golden sets, and time in proportion to the text."""

import time

import pytest

from lithic.operators.code import scan
from lithic.operators.lexing import Tokens

JAVA = """package a; import java.util.List; import static x.Y.z; import a.b.*;
@Foo("x") public class A<T extends B> extends Base implements C, D<E>, f.G {
  @Inject A() { this(1); }
  public A(int x) { super(x); init(x); }
  <T> A(T t) { }
  private final List<String> l = new ArrayList<>(mk());
  int n = calc(2), m = other.calc(3);
  @Override public <T> Map<String, List<T>> foo(List<? extends X> a) throws E, F { return new Bar.Baz(x()).go(1); }
  abstract int g();
  int[] arr()[] { return null; }
  String block = \"\"\"
     no("call"); class Not {} \"\"\";
  void h() { obj.<String>typed(1); Runnable r = new Runnable() { public void run() { inner('('); } }; if (a < b && c > d(e)) { } class Local { void lm() {} } switch (x) { case 1: q(); } Foo f = (Foo) cast(1); List::of; x -> y(x); assert ok(); }
  enum Kind { X(1), Y(mk(2)) { void over() { } }; Kind(int i) { set(i); } void em() { } }
  record P(int a, int b) { P { check(a); } static void st() {} }
  @interface Ann { int value() default 0; }
  interface I extends J, K<L> { void im(); default void dm() { called(); } }
}"""
JAVA_SYMBOLS = "class A, method foo, method g, method arr, method h, method run, class Local, method lm, method over, method em, method st, interface I, method im, method dm"
JAVA_FACTS = "IMPORTS java.util.List, IMPORTS x.Y.z, IMPORTS a.b, EXTENDS Base, IMPLEMENTS C, CALLS init, CALLS mk, CALLS calc, CALLS calc, CALLS x, CALLS go, CALLS typed, CALLS inner, CALLS d, CALLS q, CALLS cast, CALLS y, CALLS ok, CALLS mk, CALLS set, CALLS check, EXTENDS J, CALLS called"

TYPESCRIPT = """import a from './a'; import './side'; import type { T } from "./t.js"; import x = require('./r'); const q = require('./q'); import('./dyn').then(z);
export { one } from './e'; export * from './s';
export abstract class Abs { abstract am(): void; m() { } }
@Dec({a: 1}) export default class W<T> extends Base<T> implements Shown, Sized<T> {
  private x = foo(1);
  y = 3
  constructor(private a: string) { super(a); this.z(); }
  get p(): number { return 1 }
  static async *gen() { }
  #priv() { this.#priv(); }
  over(a: string): void;
  over(a: any): { a: string; b(): void } | null { return make<string>(a) ?? bar?.(1); }
  arrow = (a) => helper(a);
  'quoted'() { }
  cond(x): x is string { if (a) { b(`t ${inner(`n ${deep()}`)} (no())`) } return /re(x)g/.test(y) / div(2); }
}
interface Shown extends Drawn, Sized<X> { draw(x: number): void; prop: (a) => void; new (x): Y; meth?(): void }
function f(a: string): void; function f(a) { return g(a); }
function* gen() { y(); }
export async function af() { await call(); }
export const arrow = async <T>(x: T) => { once(x) };
const o = { z() { a(); }, async w() {}, k: function named() { b(); }, get v() { return 1; }, t: call(2), [comp]() {} };
namespace NS { export function nf() {} } module MM { } declare module "x" { }
enum E { A = comp(1) } type TT = { sig(): void };
switch (a) { case 1: { blk(); } default: { dflt() } }
for (const a of list()) { z() }
export enum EE {} export let v = 1; export type Q = string; export { o };
new Foo.Bar<Baz>(arg()); class2(1); x = class Named { mm() {} }; if (a < b) { c > (d) }
"""
TYPESCRIPT_SYMBOLS = "method m, class W, method constructor, method p, method gen, method over, method over, method b, method cond, interface Shown, method draw, method meth, function f, function af, method z, method w, method v, module NS, function nf, module MM, method sig, method mm"
TYPESCRIPT_FACTS = (
    "IMPORTS ./a, IMPORTS ./side, IMPORTS ./t.js, CALLS require, CALLS then, CALLS Dec, EXPORTS W, EXTENDS Base, IMPLEMENTS Shown, CALLS foo, CALLS z, CALLS make, CALLS bar, CALLS helper, CALLS b, CALLS inner, CALLS deep, CALLS test, CALLS div, EXTENDS Drawn, CALLS g, CALLS y, "
    "EXPORTS af, CALLS call, CALLS once, CALLS a, CALLS b, CALLS call, EXPORTS nf, CALLS comp, CALLS blk, CALLS dflt, CALLS list, CALLS z, CALLS arg, CALLS class2"
)

MARKUP = """const el = <div className="x" onClick={() => go()}>it's {show(1)} <b>no(bold)</b> <Foo {...p} /> text's</div>; after();
function C() { return (<><A b={c(`x ${y()}`)}/> don't </>); }
const g = a < b; if (a / b > c) d();
class A extends B { m(){n()} }"""

CASES = {
    "java": (JAVA, "java", JAVA_SYMBOLS, JAVA_FACTS),
    "typescript": (TYPESCRIPT, "typescript", TYPESCRIPT_SYMBOLS, TYPESCRIPT_FACTS),
    "markup": (MARKUP, "tsx", "function C, class A, method m", "CALLS go, CALLS show, CALLS after, CALLS c, CALLS y, CALLS d, EXTENDS B, CALLS n"),
    "new is no call": ("new X(); new a.b.Y<Z>(w());", "java", "", "CALLS w"),
    "annotations are no calls": ('@Foo("x") class A { @Bar(y) int z; }', "java", "class A", ""),
    "constructors": ("class A { A() { this(1); } public A(int i) { } @In A(long l) { } }", "java", "class A", ""),
    "constants": ("enum E { X(1), Y(2); int f() { return g(); } }", "java", "method f", "CALLS g"),
    "object methods": ("x = { z() { y() }, w: 1 }", "javascript", "method z", "CALLS y"),
    "private methods": ("class A { #p() { this.#p(); q() } }", "javascript", "class A", "CALLS q"),
    "calls in templates": ("`a ${f(`b ${g()} h()`)} i()`; j()", "javascript", "", "CALLS f, CALLS g, CALLS j"),
    "arrows": ("const f = async <T>(x) => g(x); const h = async (x) => 1;", "typescript", "", "CALLS g"),
    "exports": ("export const a = 1; export enum E {} export type T = 1; export { a }; export namespace N {} export interface I {} export function f() {}", "typescript", "module N, interface I, function f", "EXPORTS I, EXPORTS f"),
    "comments and strings": ("// f()\n/* g() */ 'h()' + \"i('\" + k() /* open l()", "javascript", "", "CALLS k"),
    "regular expressions": ("a = b / c(1) / d; e(/[/'](/.test(x)); f = y ? /'/ : g()", "javascript", "", "CALLS c, CALLS e, CALLS test, CALLS g"),
    "unbalanced": ("}}) class A { m( { f() } class B { g() { h() }", "javascript", "class A, class B, method g", "CALLS h"),
    "empty": ("", None, "", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(name):
    text, language, symbols, facts = CASES[name]
    found = scan(text, language)
    assert ", ".join(f"{s[0]} {s[1]}" for s in found[0]) == symbols
    if name == "unbalanced":
        assert ("CALLS", "h") in {f[:2] for f in found[1]}
    else:
        assert ", ".join(f"{f[0]} {f[1]}" for f in found[1]) == facts


def test_places():
    symbols, facts = scan(TYPESCRIPT, "typescript")
    for _, name, at, end in symbols:
        assert TYPESCRIPT[at : at + len(name)] == name and at < end <= len(TYPESCRIPT)
    for kind, name, at, _ in facts:
        assert TYPESCRIPT[at:].startswith("import" if kind == "IMPORTS" else name)


def test_brackets_match():
    tokens = Tokens("f(a[1], {b: `x ${c(d)} y`}) < g<T>(h)", "typescript")
    for k, other in enumerate(tokens.partner):
        if other >= 0:
            assert tokens.partner[other] == k and {tokens.text[k], tokens.text[other]} in ({"(", ")"}, {"[", "]"}, {"{", "}"}, {"<", ">"})


LONG = ["// a licence\n", "\n", "class a ", "public ", "a<", "f(", "a(): ", "`${", "@a.", "{", "<a>", "import ", "new a.", "function f ", "class a extends b, ", "/* ", "'", "if (a) /", "a ? b : ", "case a: ", "export "]


@pytest.mark.parametrize("language", ["java", "tsx", "typescript"])
@pytest.mark.parametrize("piece", LONG)
def test_time_in_proportion(piece, language):
    """A text of twice the length takes about twice the time, whatever it repeats."""

    def seconds(size):
        text = piece * (size // len(piece))
        began = time.process_time()
        scan(text, language)
        return time.process_time() - began

    once, twice = seconds(100_000), seconds(200_000)
    assert twice < 4 * once + 0.5 and twice < 4
