"""Regions of TypeScript and JavaScript: what counts as code, and what falls back to windows."""

from millrace.operators.chunking import TARGET, line_windows, structural
from millrace.operators.scripts import regions


def found(code):
    got = regions(code.split("\n"))
    return None if got is None else [(r.symbol, r.first + 1, r.last + 1) for r in got]


def test_functions_classes_and_values():
    code = """import { a } from './a'
// function not() {
export default async function* first<T extends { x: 1 }>(a: { b: string } = {}): Promise<{ c: T }> {
  return a
}
const helper = (a, b) => {
  return `}` + "{" + '{' + /[/{]}/.test(a)
}, other = 3
export const arrow = async <T>(x: T): Promise<T> => {
  return x
}
let plain = function () { return 1 };
const short = x => x * 2
const text = `a ${x ? `b ${'}'} }` : { c: 1 }} {`
const number = 4 / 2 / 1
function overload(a: string): string;
function overload(a: any) {
  /* } */
  return a
}
@Injectable({ a: '{' })
export class Service extends Base<{ y: 1 }> implements Other {
}
abstract class Left {
  a() {}
}
type X = { a: 1 }
export { helper as default }"""
    assert found(code) == [("first", 3, 5), ("arrow", 9, 11), ("plain", 12, 12), ("short", 13, 13), ("overload", 17, 20), ("Service", 21, 23)]


CLASS = """export class Shape {
  private readonly x: { a: string } = { a: '}' }
  static count = 0
  handler = () => {
    return 1
  }

  constructor(private y: number) {
    super()
  }

  @Get({ path: '/{' })
  async area<T>(a: T, b = `{${'}'}`): Promise<{ r: T }> {
    if (a) { return { r: a } }
    return { r: a }
  }
  abstract later(): void;
  get size() { return this.x }
  set size(v) { this.x = v }
  get() { return 2 }
  *[Symbol.iterator]() {
    yield 1
  }
  #secret() {}
  'quoted name'() {}
}"""


def test_methods_of_large_classes():
    r = regions(CLASS.split("\n"))[0]
    names = ["constructor", "area", "size", "size", "get", "[Symbol.iterator]", "#secret", "'quoted name'"]
    assert [m.symbol for m in r.methods] == [f"Shape.{n}" for n in names]
    assert [(m.first + 1, m.last + 1) for m in r.methods] == [(8, 10), (13, 16), (18, 18), (19, 19), (20, 20), (21, 23), (24, 24), (25, 25)]
    large = CLASS.replace("    super()\n", "    super()\n" + "    this.y = 1\n" * 70)
    parts = structural(large.split("\n"), "ts")
    assert {i for p in parts for i in range(p.start, p.end)} == set(range(len(large.split("\n"))))
    assert [p.symbol for p in parts] == ["Shape", "Shape.constructor", "Shape.constructor", "Shape", "Shape.area", "Shape", *[f"Shape.{n}" for n in names[2:]], "Shape"]
    small = structural(CLASS.split("\n"), "ts")
    assert [p.symbol for p in small] == ["Shape"] and len(CLASS.split("\n")) <= TARGET


def test_doubt_falls_back_to_windows():
    for code in ("function a() {\n  '\n}", "class A {", "function a() { ( }", "const t = `${`", "}", "const j = <p>don't</p>", "/* open"):
        assert regions(code.split("\n")) is None
        lines = code.split("\n") * 1
        assert structural(lines, "tsx") == line_windows(lines)
    assert regions([]) == [] and regions([""]) == []
