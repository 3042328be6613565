"""What Python and TypeScript texts declare: the rules on made texts, broken ones among them."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.declared import python_declarations, script_declarations, script_tokens
from tessera.operators import ingestion


def told(found):
    return [(q, k, a, b) for _, q, k, a, b in found[0]], found[1]


def test_python_modules_and_classes_only():
    text = "@d\ndef f():\n    def g(): pass\nclass C:\n    x = 1\n    class D:\n        async def m(self): pass\n    @p\n    @q(1,\n       2)\n    def k(self):\n        return 1\nif x:\n    def no(): pass\n"
    want = [("f", "function", 1, 3), ("C", "class", 4, 12), ("C.D", "class", 6, 7), ("C.D.m", "method", 7, 7), ("C.k", "method", 8, 12)]
    assert told(python_declarations(text)) == (want, False)
    assert told(python_declarations("")) == ([], False)


def test_broken_python_tells_what_can_be_read():
    text = "class A:\n    @p\n    def m(self, a=')'):\n        '''doc\ndef no():\n'''\n        x = (1,\n  2)\n\n    def n(self):\n        if x:\n            def inner(): pass\n        return\n# c\ndef broken(:\n    pass\nclass Z:\n\ty = 1\n\tdef q(self): pass\nprint 'x'\n"
    want = [("A", "class", 1, 13), ("A.m", "method", 2, 8), ("A.n", "method", 10, 13), ("broken", "function", 15, 16), ("Z", "class", 17, 19), ("Z.q", "method", 19, 19)]
    assert told(python_declarations(text)) == (want, True)
    assert python_declarations("a\0b")[1] and python_declarations("def (")[0] == []


PYTHON = st.lists(st.sampled_from(["class A:\n    def m(self):\n        return 'def x(:'\n", "def f(a=(1,\n   2)):\n    '''class B:'''\n    pass\n", "@d\nasync def g():\n\n    # def no():\n    pass\n", "x = {\n  'a': 1}\n", "class C(\n    B):\n    x = 1\n    class D:\n        def n(self): pass\n\n"]), max_size=6).map("".join)


@settings(max_examples=150, deadline=None)
@given(PYTHON)
def test_a_broken_line_at_the_end_hides_nothing(text):
    """The reader of broken texts tells of a good text what Python's grammar tells."""
    whole, _ = python_declarations(text)
    cut, broken = python_declarations(text + "def :\n")
    assert broken and cut == whole


SCRIPT = """import { a } from "./a"; // class No {
export interface Shape {
  area(): number;
}
@Injectable({ a: 1 })
export default class Box<T extends { a: string }> extends mixin({ b: 1 }) implements Foo {
  private size = { a: 1 };
  handler = () => { return 1 }
  static async load(path: string): Promise<{ ok: boolean }> {
    if (path) { return new Box() }
    function inner() {}
  }
  get area() { return 1 }
  abstract nope(): void;
  @Input() @Other
  set value(v: number) { this.v = /[{]/.test(`${v}`) }
  static(x) { return x }
  constructor(private a: string) { super() }
  [Symbol.iterator]() { return 1 }
  #hidden?: string
  *gen<T>(x: T): Iterator<T> { yield x }
  overload(a: string): void;
  overload(a: any) { }
}
export const make = async (n: number): Promise<Box> => {
  return new Box()
}, other = function () { return 2 }, third = 5
const hidden = (a) => a
export const { x, y } = make()
export const expr = a => a + 1;
type Id = string
type U<T> =
  | { a: T }
  | string;
const enum Color {
  Red,
}
declare function sig(a: string): void;
declare class Amb { m(): void; }
namespace N { export class Inside {} }
const text = `function no() { ${ `nested ${1} {` } }`;
if (x) { function blocked() {} }
async function last<T>(x: T): { a: string } {
  function inner() {}
  return inner
}
function* gen() { }
export function over(a: string): string
export function over(a: any) { return a / 2 / 3 }
const z = class Named { m() {} }
let r = a
  .b()
abstract class Abs { abstract q(): void; w() {} }
"""


def test_scripts():
    want = [
        ("Shape", "interface", 2, 4), ("Box", "class", 5, 24), ("Box.load", "method", 9, 12), ("Box.area", "method", 13, 13), ("Box.value", "method", 15, 16), ("Box.static", "method", 17, 17),
        ("Box.constructor", "method", 18, 18), ("Box.[Symbol.iterator]", "method", 19, 19), ("Box.gen", "method", 21, 21), ("Box.overload", "method", 23, 23), ("make", "function", 25, 27), ("other", "function", 27, 27),
        ("expr", "function", 30, 30), ("Id", "type_alias", 31, 31), ("U", "type_alias", 32, 34), ("Color", "enum", 35, 37), ("Amb", "class", 39, 39), ("last", "function", 43, 46), ("gen", "function", 47, 47),
        ("over", "function", 49, 49), ("Abs", "class", 53, 53), ("Abs.w", "method", 53, 53),
    ]
    assert told(script_declarations(SCRIPT)) == (want, False)
    assert told(script_declarations("")) == ([], False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export class A {\n  m() { if (x) {\n  }\nexport function g() {}\nclass B { n() {} }\n", [("A", "class", 1, 3), ("A.m", "method", 2, 3), ("g", "function", 4, 4), ("B", "class", 5, 5), ("B.n", "method", 5, 5)]),
        ("class A {", [("A", "class", 1, 1)]),
        ("const x = 'abc\nfunction f() {}\n", [("f", "function", 2, 2)]),
        ("function f() {}\n/* open", [("f", "function", 1, 1)]),
        ("function f() {}\n}\n)\nclass G {}\n", [("f", "function", 1, 1), ("G", "class", 4, 4)]),
        ("const t = `open ${ {\nclass A {}\n", []),
    ],
)
def test_broken_scripts(text, want):
    assert told(script_declarations(text)) == (want, True)


def test_elements_and_their_texts():
    text = "export function App() {\n  return <div className='a'>don't {x ? <b/> : null} and/or </div>\n}\nexport const B = () => <p>it's</p>\nfunction z() {}\n"
    assert told(script_declarations(text, True)) == ([("App", "function", 1, 3), ("B", "function", 4, 4), ("z", "function", 5, 5)], False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("{}()[]`'\"/$<>=;:\n aclsfunctio"), max_size=80))
def test_any_text_is_read(text):
    """Nothing raises, lines lie within the text, and tokens keep its order."""
    tokens, _ = script_tokens(text)
    assert [t.line for t in tokens] == sorted(t.line for t in tokens)
    for reader in (script_declarations, python_declarations):
        for _, _, _, start, end in reader(text)[0]:
            assert 1 <= start <= end <= text.count("\n") + 1


def test_parsed_files(spark):
    files = spark.createDataFrame([("a.py", "def f():\n  pass\n"), ("b.ts", "class A {"), ("c.tsx", None), ("d.py", ""), ("e.txt", "def g(): pass"), ("f.py", "def h(:\n")], "path string, content string")
    parsed = ingestion.parsed_files(files)
    assert {(r.path, r.qualified_name) for r in ingestion.declarations(parsed).collect()} == {("a.py", "f"), ("b.ts", "A"), ("f.py", "h")}
    assert {(r.path, r.reason) for r in ingestion.unsupported_syntax(parsed).collect()} == {("b.ts", "unsupported_syntax"), ("f.py", "unsupported_syntax")}
    assert ingestion.declarations(ingestion.parsed_files(files.limit(0))).count() == 0
