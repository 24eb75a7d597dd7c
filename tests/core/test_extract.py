"""Facts of source text, language by language."""

import pytest

from repograph.extract import facts_of


def said(path, language, text):
    f = facts_of(path, language, text)
    return f, {(s[2], s[0], s[3], s[4], s[6]) for s in f.symbols}


def test_rust_items_impls_and_uses():
    f, symbols = said(
        "a.rs",
        "rust",
        """// struct Not {}
/* fn no() { /* nested */ } */
#[derive(Clone)]
pub(crate) struct Pair<'a, T> where T: Copy {
    name: &'a str, other: T,
}
enum Shape { Round(f64), Flat { w: u8 } }
pub unsafe trait Draw: Base + fmt::Debug + 'static { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
impl<'a, T> Draw for Pair<'a, T> { }
impl Pair<'_, u8> { pub async fn make() -> Self { Pair { name: r#"}"#, other: helper::<u8>() } } }
mod inner { fn run(x: Shape) { match x { Shape::Round(r) => sink(r), Shape::Flat { w } if check(w) => Pair::make(), _ => {} } println!("{}", hidden()); let c = '{'; a.go(); } }
macro_rules! m { () => { fn ghost() {} } }
extern "C" { fn foreign(); }
""",
    )
    assert symbols == {
        ("struct", "Pair", 4, 6, True), ("enum", "Shape", 7, 7, False), ("trait", "Draw", 8, 8, True), ("function", "twice", 8, 8, False), ("function", "make", 10, 10, True),
        ("module", "inner", 11, 11, False), ("function", "run", 11, 11, False),
    }
    assert f.supertypes == {("Pair", "Draw", "implements"), ("Draw", "Base", "inherits"), ("Draw", "Debug", "inherits")}
    assert {("run", x) for x in ("sink", "check", "Pair", "make", "go")} | {("make", "Pair"), ("twice", "area")} == f.references


def test_csharp_members_bases_and_uses():
    f, symbols = said(
        "a.cs",
        "csharp",
        """using System;
using static Acme.Tools.Text;
using Short = Acme.Long;
namespace Acme.Sales;
[Serializable]
public sealed class Order<T> : Base<T>, IOrder where T : class, new()
{
    private readonly Dictionary<string, Line> _lines = new Dictionary<string, Line>();
    public Customer Buyer { get; set; }
    internal Order(Customer buyer) : base(buyer) { Buyer = buyer; }
    public async Task<Total> Sum(IEnumerable<Line> lines, int n = 3)
    {
        var x = new Rate(2); foreach (var l in lines) { x.Add(l); }
        int Local(Line q) => q.Size();
        return await Compute<Money>(x).Round();
    }
    protected (int, string) Both() => (1, "}");
    public static bool operator ==(Order<T> a, Order<T> b) => true;
    int this[int i] => Get(i);
}
interface IOrder : IThing { void Close(); }
public record Line(string Name, Money Price) : Entity(Name);
enum Kind { A, B }
struct Money : IMoney { }
delegate void Changed(Order o);
""",
    )
    assert symbols == {
        ("class", "Order", 5, 20, True), ("constructor", "Order", 10, 10, False), ("method", "Sum", 11, 16, True), ("method", "Both", 17, 17, False), ("interface", "IOrder", 21, 21, False),
        ("method", "Close", 21, 21, False), ("record", "Line", 22, 22, True), ("enum", "Kind", 23, 23, False), ("struct", "Money", 24, 24, False),
    }
    assert f.imports == {"System", "Acme.Tools.Text", "Acme.Long"}
    assert f.supertypes == {("Order", "Base", "unknown"), ("Order", "IOrder", "unknown"), ("Money", "IMoney", "unknown")}
    wanted = {("Order", "Dictionary"), ("Order", "Line"), ("Order", "Customer"), ("Sum", "IEnumerable"), ("Sum", "Line"), ("Sum", "Rate"), ("Sum", "Add"), ("Sum", "Compute"), ("Sum", "Money"), ("Sum", "Size"), ("Line", "Money"), ("", "Order")}
    assert wanted <= f.references and ("Sum", "Round") not in f.references and ("Sum", "Local") not in f.references


def test_python_by_parser_and_by_indentation():
    text = '''class Stock(base.Model, Generic[T], object):
    """def no(): pass"""

    @property
    def _level(self):
        async def inner():
            return 1
        return inner

def later(): pass
'''
    want = {("class", "Stock", 1, 8, True), ("function", "_level", 5, 8, False), ("function", "inner", 6, 7, True), ("function", "later", 10, 10, True)}
    f, symbols = said("a.py", "python", text)
    assert symbols == want and f.supertypes == {("Stock", "Model", "inherits")} and not f.references
    broken, symbols = said("a.py", "python", text.replace(", Generic[T]", "") + "print 'old'\n")
    assert symbols == want and broken.supertypes == {("Stock", "Model", "inherits")}


def test_go_groups_take_the_kind_and_lines_of_their_declaration():
    f, symbols = said(
        "a.go",
        "go",
        """package a
type (
	Box struct {
		*io.Reader
		Named
		a, b int `json:"{"`
	}
	Lid interface { Close() error; fmt.Stringer }
	Alias = Box
	Number int
)
type Set[T comparable] struct { m map[T]struct{} }
type Later int
func Make[T any](f func(int) error) interface{} {
	type local struct{ Box }
	return func() {}
}
func (b *Box) Open() (n int, err error) { return }
func asm(x int)
""",
    )
    assert symbols == {
        ("struct", "Box", 2, 11, True), ("struct", "Lid", 2, 11, True), ("struct", "Set", 12, 12, True), ("function", "Make", 14, 17, True), ("struct", "local", 15, 15, False),
        ("method", "Open", 18, 18, True), ("function", "asm", 19, 19, False),
    }
    assert f.supertypes == {("Box", "Reader", "inherits"), ("Box", "Named", "inherits"), ("Lid", "Stringer", "inherits"), ("local", "Box", "inherits")}


def test_typescript_declarations_heritage_and_types():
    f, symbols = said(
        "a.ts",
        "typescript",
        """import x, { y as z } from 'lodash/fp'; import './local'; import type { Q } from "@scope/pkg/sub";
const chalk = require('chalk');
export interface Shape extends Base<Key>, ns.Other { area(of: Unit): Size; [k: string]: any }
export type Id = string | Brand<'a'>
  & Tag;
declare const enum Mode { A }
export default class Circle<T extends Bound> extends Round<T> implements Shape, Sized {
  private r: Radius = new Radius(1);
  constructor(readonly unit: Unit) { super(); }
  grow(by: Factor): Circle<T> { return make<Item>(by as Step, /[}/]/.test("x")); }
}
abstract class Hidden extends Gone {}
const half = async (s: Shape): Promise<Size> => {
  return s.area() < 2 ? `${ask(s)}` : null;
}, other = function () {}, called = wrap(() => 1);
function over(a: string): void;
function over(a: any) { function inner() {} }
export { half as renamed };
function* gen() {}
let late = function () {}.bind(0)
""",
    )
    assert symbols == {
        ("interface", "Shape", 3, 3, True), ("type", "Id", 4, 5, True), ("enum", "Mode", 6, 6, False), ("class", "Circle", 7, 11, True), ("function", "half", 13, 15, True), ("function", "other", 13, 15, False),
        ("function", "over", 17, 17, False), ("function", "inner", 17, 17, False),
    }
    assert f.imports == {"lodash", "@scope/pkg", "chalk"}
    assert f.supertypes == {("Shape", "Base", "inherits"), ("Shape", "Other", "inherits"), ("Circle", "Round", "inherits"), ("Circle", "Shape", "implements"), ("Circle", "Sized", "implements")}
    wanted = {("Circle", "Bound"), ("Circle", "Radius"), ("Circle", "Sized"), ("constructor", "Unit"), ("grow", "Factor"), ("grow", "Circle"), ("grow", "Item"), ("grow", "Step"), ("grow", "make"), ("half", "Shape"), ("half", "Size"), ("half", "area"), ("half", "ask"), ("called", "wrap"), ("", "Brand"), ("", "Tag"), ("", "Unit")}
    assert wanted <= f.references, wanted - f.references
    assert not {t for _, t in f.references} & {"string", "any", "if", "x", "over"}


def test_javascript_markup_and_components():
    text = """export const Page = ({ a }) => (
  <div className="it's">Don't {a.map(i => <Row key={i} on={() => go(i)}/>)} stop { /* } */ }</div>
);
class Panel extends React.Component { render() { return <></>; } }
module.exports = { f() { return g(); } };
"""
    f, symbols = said("a.jsx", "javascript", text)
    assert symbols == {("component", "Page", 1, 3, True), ("component", "Panel", 4, 4, False)} and not f.supertypes
    assert {("Page", "map"), ("Page", "go"), ("f", "g")} <= f.references
    assert {s[0] for s in said("a.js", "javascript", text)[1]} == {"function", "class"}


def test_svelte_scripts_and_routes():
    f, symbols = said("app/routes/shop/+page.svelte", "svelte", '<p>x</p>\n<script lang="ts">\n  export function pick(a: Id) {}\n</script>\n<script context=\'module\' lang="js">const Load = () => 1;</script>\n')
    assert symbols == {("component", "shop/+page", 1, 6, True), ("function", "pick", 3, 3, True), ("component", "Load", 5, 5, False)}
    assert f.symbols[0][1] == "shop/+page (sveltekit page)" and f.symbols[0][5] == "page" and not f.references


def test_shell_yaml_json_and_markdown():
    assert said("a.sh", "bash", "# f() {\nfunction up {\n  echo \"}\" ${x}\n}\ndown() {\ncat <<EOF\nno() {\nEOF\n}\n")[1] == {("function", "up", 2, 4, True), ("function", "down", 5, 9, True)}
    yaml = "# c\na: &top 1\n'b c':\n  d: |\n    x: y\n  e: [1, &in 2]\nf:\n- g: 1\n"
    assert said("a.yml", "yaml", yaml)[1] == {("key", "a", 2, 2, False), ("key", "top", 2, 2, False), ("key", "'b c'", 3, 6, False), ("key", "in", 6, 6, False), ("key", "f", 7, 8, False)}
    assert said("a.json", "json", '[1, {"a": {"b": 1},\n "c": [2,\n 3], "": 4}]')[1] == {("key", "a", 1, 1, False), ("key", "c", 2, 3, False)}
    md, symbols = said("a.md", "markdown", "# One  two ##\n```\n# no\n```\nSet\n===\n\ntext\n---\n    # code\n")
    assert [(s[1], s[3]) for s in md.symbols] == [("h1 One two", 1), ("h1 Set", 5), ("h2 text", 8)] and symbols


@pytest.mark.parametrize("language", ["rust", "csharp", "python", "go", "javascript", "typescript", "svelte", "bash", "yaml", "json", "markdown", "other"])
def test_no_text_is_an_error(language):
    for text in ("", "\n", "\0", "{", "}", "(((", "class", "fn", "type", "\"", "'", "`${", "<script>", "/*", "<<EOF", "a: b: c", "interface A extends", "export", "é" * 9, "{" * 3000, "x(" * 500, "<a>" * 300, "a<" * 300):
        facts_of(f"a.{language}", language, text)
