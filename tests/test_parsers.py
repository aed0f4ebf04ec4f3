"""Parsers of source files on code as people write it, on what looks like code within strings, and on hostile texts."""

import time

import pytest

from topograph.sources import c_like
from topograph.sources.c_like import Source


def fqns(rows):
    return [x[2] for x in rows["symbol"]]


def specifiers(rows):
    return [x[1] for x in rows["import"]]


def test_brackets_know_each_other():
    s = Source("a(b[c]{d}) ] e(f{g)h} }", "java")
    pairs = {(s.text[i] + str(i), s.text[j] + str(j)) for i, j in enumerate(s.pair) if j > i}
    assert pairs == {("(1", ")9"), ("[3", "]5"), ("{6", "}8"), ("{14", "}18")}
    s = Source("f<a, b<c>>(x); a < b; c > d", "java")
    assert [(i, j) for i, j in enumerate(s.angle) if j > 0] == [(1, 8), (5, 7)]


def test_positions_count_bytes():
    rows = c_like.javascript("/* äö */ import 'a';\n\n  import '日';\nconst ü = require('b');\n")
    assert [(x[1], x[4], x[5]) for x in rows["import"]] == [("a", 1, 11), ("日", 3, 2), ("b", 4, 11)]


JAVA = '''package com.example;
import java.util.List;
import static java.lang.Math.abs;
import static a.b.C.*;
import com . example . Spaced ;
/* import no.Comment; */ // import no.Line;
@Config(value = "import no.Text;", n = {1, 2})
public final class Outer<T extends Comparable<T>> extends Base<T> implements One, Two<Map<String, T>> {
    private static final String BLOCK = """
        import fake.Fake;
        class Not { void no() {} }
        \\""" still inside
        """;
    private final Runnable r = new Runnable() { public void run() { inner(); } };
    int size = compute(3) + this.other(4), rest = size > limit(5) ? 1 : 2;
    static { init(); }
    public Outer(int x) { super(x); }
    @Override @Deprecated(since = "9") public <R> Map<String, List<R>> convert(T in, R... out) throws IOException { return helper(in); }
    int[] array() { return new int[] {1}; }
    abstract void nothing();
    record Point(int x, int y) implements Shape { Point { check(x); } int sum() { return x + y; } static Point of(int a) { return null; } }
    record Pair<A, B>(A a, B b) { }
    enum Color { RED("r"), GREEN("g"); Color(String s) {} String label() { return ""; } }
    interface Call { void go(); default int twice() { return 2; } }
    @interface Mark { String value() default "class X {}"; }
    int record(int x) { int record = x; return record(record); }
}
'''


def test_java():
    rows = c_like.java(JAVA)
    assert specifiers(rows) == ["java.util.List", "java.lang.Math.abs", "a.b.C.*", "com.example.Spaced"]
    assert [x[0] for x in rows["import"]] == ["import java.util.List;", "import static java.lang.Math.abs;", "import a.b.C.*;", "import com.example.Spaced;"]
    assert [x[4] for x in rows["import"]] == [2, 3, 4, 5] and [x[6] for x in rows["import"]] == [False, False, True, False]
    assert fqns(rows) == [
        "class:Outer", "class:Point", "class:Pair", "enum:Color", "interface:Call", "annotation:Mark",
        "method:Outer.convert", "method:Outer.array", "method:Outer.nothing", "method:Point.sum", "method:Point.of", "method:Call.go", "method:Call.twice", "method:Outer.record",
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("public class MyClass {\n public void doSomething() {}\n private int count;\n}", ["class:MyClass", "method:MyClass.doSomething"]),
        ("class Foo { void a() {} }\ninterface Bar {}\nenum Baz { A, B }", ["class:Foo", "interface:Bar", "enum:Baz", "method:Foo.a"]),
        ("class Broken { void a( { } int b() {} }", ["class:Broken", "method:Broken.a", "method:Broken.b"]),
        ("class Open { int a() { ", ["class:Open", "method:Open.a"]),
        ("", []),
    ],
)
def test_java_declarations(text, want):
    assert fqns(c_like.java(text)) == want


KOTLIN = '''@file:JvmName("Tools")
package com.example.`in`

import kotlin.math.abs
import a.b.C as D
import a.b.*
import a.`object`.E
/* import no.Comment /* nested */ import still.Comment */
val text = "import no.Text ${ listOf("x", "}").map { "fun no() = $it" } } class No"
val raw = """
import fake.Fake
fun fake() = ${ text.length } """"
var String?.extended: Int
    get() = 1
fun <T> List<T>.second(): T = this[1]
fun <K, V : Comparable<V>> Map<K, List<V>>.third() where K : Any { fun local() {} }
fun String?.orNothing() = this
fun (Int.() -> Unit).run() {}
fun `with spaces`() {}
inline fun <reified T> generic(x: T) = x
abstract class Outer<T>(val first: Int, private var second: List<String> = listOf("a"), third: Int) : Base<T>(first), Face by Other {
    val name: String by lazy { val hidden = 1; "x" }
    init { val local = 2 }
    fun run(f: (Int) -> Unit) { val local = 3; class Local }
    class Inner { fun innerMethod() {} ; val p = 1 }
    companion object { const val K = 1; fun make() = Outer() ; class Nested }
    companion object Named { fun named() {} }
    object Single { fun one() {} }
    interface Callback { fun call() }
}
annotation class Config(val key: String)
enum class Color { RED { fun hue() = 1 }, GREEN; fun label() = name }
data object Nothing
fun interface Action { fun act() }
sealed interface Shape
val anonymous = object : Shape { fun hidden() {} }
typealias Names = List<String>
'''


def test_kotlin():
    rows = c_like.kotlin(KOTLIN)
    assert specifiers(rows) == ["kotlin.math.abs", "a.b.C as D", "a.b.*", "a.`object`.E"]
    assert c_like.kotlin_package(KOTLIN) == "com.example.in"
    assert fqns(rows) == [
        "class:Outer", "class:Outer.Inner", "class:Outer.Nested", "class:Outer.Single", "class:Outer.Callback", "class:Config", "class:Color", "class:Nothing", "class:Action", "class:Shape",
        "property:text", "property:raw", "property:extended", "function:List.second", "function:Map.third", "function:String.orNothing", "function:run", "function:with spaces", "function:generic",
        "property:first", "property:second", "property:Outer.name", "method:Outer.run", "method:Outer.Inner.innerMethod", "property:Outer.Inner.p",
        "property:Outer.K", "method:Outer.make", "method:Outer.named", "method:Outer.Single.one", "method:Outer.Callback.call", "property:key", "method:Color.label", "method:Action.act", "property:anonymous",
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('fun hello() { println("hi") }', ["function:hello"]),
        ("class MyService { fun run() {} }", ["class:MyService", "method:MyService.run"]),
        ("object Logger { fun log(msg: String) {} }", ["class:Logger", "method:Logger.log"]),
        ("val PI = 3.14\nfun main() {}", ["property:PI", "function:main"]),
        ("class Outer {\n    class Inner {\n        fun innerMethod() {}\n    }\n}", ["class:Outer", "class:Outer.Inner", "method:Outer.Inner.innerMethod"]),
        ("class A\nclass B {\n fun b() {}\n}\nclass C\nfun c() {}", ["class:A", "class:B", "class:C", "method:B.b", "function:c"]),
        ("class A(\n  x: Int\n) :\n  Base(x),\n  Other\n{\n  fun a() {}\n}", ["class:A", "method:A.a"]),
    ],
)
def test_kotlin_declarations(text, want):
    assert fqns(c_like.kotlin(text)) == want


CPP = r'''// #include "no.h"
#include "local.h"  // why
  # include <sys/types.h>
/* #include "also_no.h" */
#include <vector>
#define TEXT "#include <no>" \
  void no() {
#error don't
static const char *raw = R"x(
#include "fake.h"
void fake() { }
)x";
const char *s = "void no() { \" }";
long big = 1'000'000;
template <class T> class Box : public Base<T> { T get() const noexcept { return t; } Box(int a) : Base<T>(a), b{a} { } ~Box() { } };
template <> class Box<int> { };
enum class Color { RED };
class Forward;
namespace a { namespace b { int deep(int x) { return call(x); } } }
auto trailing(int x) -> std::vector<int> { return {}; }
void Box<int>::method(const std::map<int, int> &m, int (*f)(int)) { if (x) { } for (;;) { } while (y(1)) { } }
unsigned long long wide(void)
{ return sizeof (int); }
bool operator==(const A &a, const B &b) { return true; }
int declared(int);
int value = other(3);
struct S { int in() { return 1; } };
'''


def test_cpp():
    rows = c_like.cpp(CPP)
    assert [(x[1], x[2], x[4]) for x in rows["import"]] == [("local.h", 1, 2), ("sys/types.h", 0, 3), ("vector", 0, 5)]
    assert [x[0] for x in rows["import"]] == ['#include "local.h"', "# include <sys/types.h>", "#include <vector>"]
    assert fqns(rows) == ["Box", "function:get", "function:Box", "function:Box", "Box", "function:deep", "function:trailing", "function:method", "function:wide", "function:in"]


SCRIPT = """#!/usr/bin/env node
import d, {e as f} from './default';
import * as ns from "./star";
import {
  one, // import no from 'comment';
  two
} from './many'
import type {T} from './types'
import './effect'
export * from './all';
export * as g from './named';
export {a, b as c} from './some';
export const a = 1
export const b = 2
export default function main() { return import('./dynamic'); }
const t = `import fake from 'fake';
import 'fake2';
${ require('./in-template') + `nested ${ "}" } import 'no'` }
export * from 'fake3'`;
const s = "require('x') import y from 'z'", r = /import q from 'w'/;
const cjs = require('./cjs'), dyn = require(path.join('a', 'b')), none = require(), tpl = require(`./tpl`);
module.require('./not-this');
const o = { import: 'x', from: 'y' };
function* gen() { function inner() {} }
class K extends L { m() {} }
const e = class {};
import.meta.url;
"""


@pytest.mark.parametrize("parser", [c_like.javascript, c_like.typescript])
def test_scripts(parser):
    rows = parser(SCRIPT)
    assert [(x[1], x[3]) for x in rows["import"] if x[3] == "import"] == [(x, "import") for x in ("./default", "./star", "./many", "./types", "./effect", "./all", "./named", "./some")]
    assert [(x[1], x[3]) for x in rows["import"] if x[3] != "import"] == [("./in-template", "require"), ("./cjs", "require"), ("", "dynamic"), ("", "dynamic"), ("./tpl", "require")]
    assert [x[0] for x in rows["import"]][:3] == ["import d, {e as f} from './default';", 'import * as ns from "./star";', "import { one, two } from './many'"]
    assert [x[6] for x in rows["import"]][:3] == [False, True, False]
    assert [x[1] for x in rows["symbol"]][:3] == ["main", "gen", "K"]


TS = """@Injectable({ providedIn: 'root', x: class {} })
export abstract class Service<T extends { a: string }> extends Base<T> implements One, Two {
  private readonly name: string = 'x'
  static count = 0;
  #hidden = 1
  optional?: number
  @Input({ alias: 'y' }) given!: string;
  [key: string]: unknown;
  handler = (x: number,
    y: number): void => { const z = 1; this.go(x) };
  constructor(private readonly http: Http,
    other: string) { super(); }
  async load<U>(a: { b: number },
    c: U): Promise<U> { if (a) { return f(a); } }
  get size(): number { return 1 }
  set(value: string): void {}
  *walk() {}
  abstract later(): void
  maybe?(): void
}
interface Shape { area(): number }
type Alias<T> = T | null;
enum Level { Low, High }
export function build(type: string) { type = 'x'; }
"""


def test_typescript():
    rows = c_like.typescript(TS)
    assert fqns(rows) == [
        "Service", "Shape", "Alias", "Level", "build",
        "Service.name", "Service.count", "Service.#hidden", "Service.optional", "Service.given", "Service.handler", "Service.constructor", "Service.load", "Service.size", "Service.set", "Service.walk", "Service.later", "Service.maybe",
    ]
    assert {x[0] for x in rows["symbol"] if x[2] == "Service.handler"} == {"property"} and {x[0] for x in rows["symbol"] if x[2] in ("Service.set", "Service.maybe")} == {"method"}


PARSERS = {"java": c_like.java, "kotlin": c_like.kotlin, "cpp": c_like.cpp, "javascript": c_like.javascript, "typescript": c_like.typescript}
#: Those of 512 KB, and others of 64 KB.
HOSTILE = ["int f(", "x f(((((\n", "fun <", "import a b c\n", "export const a = 1\n"]
OTHERS = [
    "import {", "export {a} ", "class a ", "class A<", "a<b>(", "f()->a ", "x f(a):g(b),", "require(", "`${", '"${', '"""${', '"""', 'R"a(', "/*", "/* */", "#include <", "# ",
    "f(){", "}", ")", "record R(", "object A:", "companion object ", "fun (", "a.b.", "val x by {", "@A(", "'", "\\", "x y(z) : a::b<c>",
]


@pytest.mark.parametrize("language", PARSERS)
def test_hostile_texts_take_linear_time(language):
    """Five seconds for 512 KB; what is quadratic takes minutes."""
    slow = []
    for pieces, size in ((HOSTILE, 1 << 19), (OTHERS, 1 << 16)):
        for piece in pieces:
            text = (piece * (1 + size // len(piece)))[:size]
            start = time.process_time()
            PARSERS[language](text)
            took = time.process_time() - start
            if took > 5 * size / (1 << 19):
                slow.append((piece, took))
    assert not slow


@pytest.mark.parametrize("language", PARSERS)
def test_any_text_is_parsed(language):
    import random

    rng = random.Random(4)
    parts = ["import ", "export ", "class ", "fun ", "record ", "object ", "companion ", "A", "b", ".", "(", ")", "{", "}", "<", ">", "[", "]", '"', "'", "`", '"""', "${", "\n", ";", ":", "=", "->", "=>", "/*", "*/", "//", "/", "#include <x>", "é", "\\", "R\"(", ")\"", "from ", "'x'", "require(", "?.", "val ", "@", "#", "*", "enum "]
    for _ in range(3000):
        PARSERS[language]("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
