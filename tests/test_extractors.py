"""Extractors on snippets of our own, rule by rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.functions.extract import html, java, javascript, typescript
from codeloom.operators import declarations as D



def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def texts(spark, blocks, content):
    rows = D.explode_blocks(files(spark, ("f", content)), blocks(F.col("content"))).orderBy("pos")
    return [r["text"] for r in rows.collect()]


def test_imports_need_one_line_and_a_semicolon(spark):
    content = (
        'import a from "./a";\nimport {\n  b\n} from "./b";\nimport "c"\n  import d from "d";\n'
        "import e from 'e';\r\nimport f;"
    )
    assert texts(spark, typescript.imports, content) == [
        'import a from "./a";', "import e from 'e';", "import f;"]


@pytest.mark.parametrize("content, expected", [
    # the closing brace at the margin ends the block without belonging to it
    ("interface A {\n  x: number;\n}\n", ["interface A {\n  x: number;"]),
    # nothing but the header: goes on to the matching brace
    ("interface A {\n}\nrest", ["interface A {\n}"]),
    # an empty line cuts a body
    ("interface A {\n  x: number;\n\n  y: number;\n}\n", ["interface A {\n  x: number;"]),
    # an empty line right after the header does not, braces are matched instead
    ("type A = {\n\n  a: { b: 1 };\n};\nx", ["type A = {\n\n  a: { b: 1 };\n}"]),
    # a following declaration ends a block and starts its own
    ("type A =\n  | 'x'\nexport type B = 1;\ninterface C {\n  z: 1;\n}",
     ["type A =\n  | 'x'", "export type B = 1;", "interface C {\n  z: 1;"]),
    # the last line needs no newline
    ("type A = string", ["type A = string"]),
    # unfinished block and unfinished brace match
    ("interface A {\n  x: 1;", ["interface A {\n  x: 1;"]),
    ("interface A {\n\n  x: { y: 1;", ["interface A {\n\n  x: { y: 1;"]),
    # text after the matching brace on the same line is not looked at
    ("type A = {\n\n} type X = 1;\ntype B = 2;\n", ["type A = {\n\n}", "type B = 2;"]),
    (" type A = 1;\nconst typeB = 2;\n", []),
    ("interface A {\r\n  x: 1;\r\n}\r\n", ["interface A {\r\n  x: 1;"]),
])
def test_ts_types(spark, content, expected):
    assert texts(spark, typescript.types, content) == expected


def test_ts_types_closed(spark):
    content = "interface A {\n  x: 1;\n}\ninterface B {\n}\ntype C = 1;\n"
    assert texts(spark, lambda c: typescript.types(c, closed=True), content) == [
        "interface A {\n  x: 1;\n}", "interface B {\n}", "type C = 1;"]


def test_ts_functions(spark):
    content = (
        "export function a(x: number): string | null {\n}\nexport async function b() {\n}\n"
        "export default function c() {}\nfunction d() {}\nexport function e(\n  x: A,\n) {\n"
    )
    assert texts(spark, typescript.functions, content) == [
        "export function a(x: number): string | null {", "export function e(\n  x: A,\n) {"]


JAVA = """package p;
import java.util.List;

public interface Api {
    Thing find(int id);
}

@Entity
@Table(name = "t")
public class Outer {
    public Outer(int size) {
    }
    @Get("/x")
    public Map<String,Integer> sizes() { return compute(1); }
    @Post
    public void many(
        int a,
        @Valid String b
    ) {
        if (a > 1) {
            return other(a);
        } else if (a < 0) {
            throw new Problem(a);
        }
    }
    private void hidden() {
    }
    class Inner {
    }
}
class Second extends Outer {}
"""


def test_java_types_outermost_with_annotations(spark):
    rows = D.explode_blocks(files(spark, ("f", JAVA)), java.types(F.col("content"))).orderBy("pos").collect()
    assert [(r["name"], r["annotations"]) for r in rows] == [
        ("Api", []), ("Outer", ["@Entity", '@Table(name = "t")']), ("Second", [])]


def test_java_brace_on_next_line_shows_inner_types(spark):
    content = "class A\n{\n  class B {\n  }\n}\n"
    assert texts(spark, java.types, content) == ["class A", "  class B {"]


def test_java_signatures(spark):
    rows = D.explode_blocks(
        files(spark, ("f", JAVA)), java.signatures(F.col("content"))).orderBy("pos").collect()
    assert [(r["kind"], r["name"], r["text"], r["annotations"]) for r in rows] == [
        ("signature", "find", "    Thing find(int id);", []),
        ("signature", "Outer", "    public Outer(int size) ;", []),
        ("signature", "sizes", "    public Map<String,Integer> sizes() ;", ['    @Get("/x")']),
        ("long_signature", "many",
         "    public void many(\n        int a,\n        @Valid String b\n    ) ;", ["    @Post"]),
    ]


def test_java_extended_signatures(spark):
    content = """class A {
  private static void hidden() {
    int x = made(3);
    if (x > 1) { return made(x); }
    for (int i = 0; i < x; i++) {
    this.start(x);
  }
  protected final synchronized Map<String, List<Long>> all(int a) throws IOException, Other {
  public <T extends A> T[] many(
      T one,
      T two) throws Problem {
  private A(int size) {
  } else if (a) {
    new Thing(a);
}
"""
    found = texts(spark, lambda c: java.signatures(c, extended=True), content)
    assert found == [
        "  private static void hidden() ;",
        "  protected final synchronized Map<String, List<Long>> all(int a) throws IOException, Other ;",
        "  public <T extends A> T[] many(\n      T one,\n      T two) throws Problem ;",
        "  private A(int size) ;"]
    # the plain form takes a single modifier for a type
    assert texts(spark, java.signatures, content) == found[3:]


def test_java_statement_words_can_be_switched_off(spark):
    found = texts(spark, lambda c: java.signatures(c, ()), "  return f(a);\n  new Thing(a);\n")
    assert found == ["  return f(a);", "  new Thing(a);"]


def test_java_unfinished_signature_ends_with_the_file(spark):
    assert texts(spark, java.signatures, "  void a(\n  int b") == ["  void a(\n  int b;"]


JS = """exports.low = () => 0;
/* kept
 whole */ import late from 'late';
import { open } from 'node:fs';
export var page = "x://y/z";
const own = require('./own');
var other = require('./other');
export function scale(width, height) { return width; }
function inner() {}
module.exports = { scale, first: 1,
  last };
export let mark = 'm';
// end
module.exports.high = 9;
"""


def test_javascript(spark):
    assert texts(spark, typescript.imports, JS) == ["import { open } from 'node:fs';"]
    assert texts(spark, javascript.requires, JS) == ["const own = require('./own');"]
    assert texts(spark, javascript.comments, JS) == ["/* kept\n whole */", '//y/z";', "// end"]
    assert texts(spark, javascript.functions, JS) == ["export function scale(width, height);"]
    assert texts(spark, javascript.variables, JS) == [
        'export var page = "x://y/z";', "export let mark = 'm';"]
    assert texts(spark, javascript.object_exports, JS) == [
        "export scale;", "export first;", "export last;"]
    assert texts(spark, javascript.member_exports, JS) == ["export low;", "export high;"]


PAGE = (
    '<%@ page a="b" %><!DOCTYPE html><HTML lang="en"><head><!-- c <i>x</i> -->'
    '<style>p{}</style><script src="s.js">var t = "</p><b>";</script></head>'
    "<body><p>one<p >two<br/><my-tag x=1><%= v %><script></script></body>"
)


def test_html(spark):
    assert texts(spark, html.jsp, PAGE) == ['<%@ page a="b" %>', "<%= v %>"]
    assert texts(spark, html.tags, PAGE) == [
        "<html ...>", "<head>", "<style>", "<script ...>", "<body>", "<p>", "<p>", "<br>",
        "<my-tag ...>", "<script>"]
    assert texts(spark, html.comments, PAGE) == ["<!-- c <i>x</i> -->"]
    assert texts(spark, html.scripts, PAGE) == ['var t = "</p><b>";', ""]
    assert texts(spark, html.styles, PAGE) == ["p{}"]


def test_quoted_attributes_may_hold_tag_ends(spark):
    page = """<div data-x="a><b c">t</div><a title=it's href='x>y'><script src="a>b">i<j</script>"""
    assert texts(spark, html.tags, page) == ["<div ...>", "<a ...>", "<script ...>"]
    assert texts(spark, html.scripts, page) == ["i<j"]
    long = "<p " + "x='>' y " * 20000 + ">"
    assert texts(spark, html.tags, long) == ["<p ...>"]


def test_summaries(spark):
    rows = files(
        spark, ("a.ts", "import x from 'x';\nimport y from 'y';\ntype A = 1;\n"),
        ("b.TXT", "as it is"), ("c.HTML", "<p>"), ("d.java", "class A {\n  @X\n  int f();\n}"),
        ("e.js", "const a = 1;"))
    found = {r["path"]: r["summary"] for r in D.summarized(rows).collect()}
    assert found == {
        "a.ts": "import x from 'x';\nimport y from 'y';\n\ntype A = 1;",
        "b.TXT": "as it is",
        "c.HTML": "JSP Blocks:\n\nHTML Tags:\n<p>\n\nComments:\n\nScripts:\n\nStyles:",
        "d.java": "class A { {\n\n}\n\n  @X\n\n  int f();",
        "e.js": "",
    }


def test_own_extractor(spark):
    def todo(content):
        lines = F.regexp_extract_all(content, F.lit(r"TODO (\w+)"), F.lit(1))
        return F.transform(lines, lambda t: F.struct(
            F.lit("todo").alias("kind"), t.alias("name"), t.alias("text")))

    own = D.BUILT_IN.adding(".TODO", todo)
    rows = files(spark, ("x.todo", "TODO a, TODO b"), ("y.other", "TODO c"))
    assert [(r["path"], r["kind"], r["name"]) for r in
            D.declaration_index(rows, own).orderBy("pos").collect()] == [
        ("x.todo", "todo", "a"), ("x.todo", "todo", "b")]
    assert D.summarized(rows, own).orderBy("path").first()["summary"] == "a\n\nb"
    # nobody else's extractors change
    assert D.declaration_index(rows).count() == 0
