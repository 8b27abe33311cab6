import pytest

from quarry.plans import java_metrics, java_names
from quarry.sources.java_lexer import lex
from quarry.sources.java_parser import ParseError, parse

SHAPE = '''
package shop.model;

import java.util.List;
import static java.util.Map.Entry;
import shop.util.*;

public abstract class Shape extends Base implements Comparable<Shape> {
    private int width, height;
    public List<String> names;

    public Shape(int width) { this.width = width; }

    public int getWidth() { return width; }
    public void setWidth(int w) { width = w; }
    abstract int area();

    @Override
    public int compareTo(Shape other) {
        for (int i = 0; i < 3; i++) {
            if (i > 1 && other != null || i == 2) {
                while (true) { break; }
            } else if (i == 0) {
                continue;
            }
        }
        switch (width) {
            case 1:
            case 2: return 1;
            default: return width > height ? 1 : 0;
        }
    }

    static <T extends Comparable<T>> T pick(List<? extends T> all) throws java.io.IOException {
        try {
            return all.stream().filter(x -> { return x != null; }).map((T y) -> y).toList().get(0);
        } catch (IllegalStateException | NullPointerException e) {
            throw new RuntimeException("no \\" quote", e) { public String toString() { return a ? b : c; } };
        } finally { int[] xs = {1, 2}, ys = new int[3]; xs[0] += ys[1] >> 2 >>> 1; }
    }

    interface Inner { int one = 1; void go(int... more); }
    enum Kind { A(1) { void f() { } }, B; Kind(int... n) { } }
    record Point(int x, int y) { Point { if (x < 0) throw new IllegalArgumentException(); } }
}
'''
BASE = "package shop.model;\npublic class Base { protected int area() { return 1; } }\n"
MODERN = '''
package shop.util;
final class Modern {
    int f(Object o) {
        var text = """
            a "block"
            """;
        int k = switch (o) { case Integer i when i > 3 -> i; case String s -> { yield s.length(); } default -> 0; };
        outer:
        do { for (String s : new String[] {"a"}) { if (s.isEmpty()) break outer; } } while (k-- > 0);
        Runnable r = Modern::go; java.util.function.Supplier<int[]> q = int[]::clone == null ? null : null;
        return (int) (k + 1L) + (o instanceof String str && !str.isBlank() ? 1 : 0);
    }
    static void go() { synchronized (Modern.class) { assert true : "no"; ; } }
}
'''


def test_lexer():
    assert [t.text for t in lex("a>>=b // c\n/* d */ 'x' \"y\\\"z\" 0x1FL 1e-3f .5 x$1")] == ["a", ">", ">=", "b", "'x'", '"y\\"z"', "0x1FL", "1e-3f", ".5", "x$1"]
    assert [t.line for t in lex('a\n"""\nq\n"""\nb')] == [1, 2, 5]


def test_parses_structures():
    unit = parse(SHAPE)
    shape = next(c for c in unit.children if c.kind == "class")
    assert (shape.name, shape.extends, shape.implements) == ("Shape", ("Base",), ("Comparable<Shape>",))
    assert [m.name for m in shape.children if m.kind == "method"] == ["getWidth", "setWidth", "area", "compareTo", "pick"]
    assert len(unit.find("lambda")) == 2 and len(unit.find("anonymous")) == 1 and len(unit.find("enum", "record")) == 2
    assert [n.op for n in unit.find("binary") if n.op in (">>", ">>>")] == [">>>", ">>"]
    modern = parse(MODERN)
    assert len(modern.find("entry")) == 3 and len(modern.find("switch-expression")) == 1 and len(modern.find("method-reference")) >= 1
    for bad in ("class {", "class A { int f( }", "class A { void f() { if } }"):
        with pytest.raises(ParseError):
            parse(bad)


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in (("model/Shape", SHAPE), ("model/Base", BASE), ("util/Modern", MODERN), ("util/Broken", "class {"), ("gen/Skipped", "package gen; class Skipped { }")):
        path = root / f"shop/{name}.java"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return java_metrics.analyze(spark, [str(root)], (r"shop\.gen\.",))


def test_metrics(analysis):
    found = {(r.level, r.entity_id, r.code): r.value for r in analysis.metrics.collect()}
    shape = "shop.model.Shape"
    method = lambda name, code: found["method", f"{shape}#{name}", code]
    compare = "compareTo(Shape)"
    # for, if, &&, ||, while, else-if, three entries, ternary
    assert method(compare, "CC") == 11
    # for 1, if 2, runs || and &&, while 3, nested if 3, switch 1, ternary 2
    assert method(compare, "CCM") == 14
    assert (method(compare, "CND"), method(compare, "LND"), method(compare, "MND"), method(compare, "NOL")) == (2, 2, 3, 2)
    assert (method(compare, "LOC"), method(compare, "NOPM")) == (14, 1)
    assert method("getWidth()", "CC") == 1 and method("area()", "LOC") == 1
    # n1: int, return; n2: width
    assert method("getWidth()", "HD") == pytest.approx(1.0) and method("getWidth()", "HVL") == pytest.approx(3 * 1.58496, abs=1e-4)
    cls = lambda code, name=shape: found["class", name, code]
    assert (cls("NOM"), cls("NOO"), cls("NOOM"), cls("NOAM"), cls("NOAC"), cls("NOPA"), cls("DIT")) == (6, 5, 1, 4, 2, 1, 2)
    assert cls("WMC") == 1 + 1 + 1 + 1 + 11 + method("pick(List<? extends T>)", "CC")
    assert cls("NOC", "shop.model.Base") == 1 and cls("DIT", "shop.model.Base") == 1
    assert cls("NOM", "shop.model.Shape.Inner") == 1 and cls("NOAM", "shop.model.Shape.Inner") == 0
    # width, height and names; Base has none. Four instance methods and Object's eleven. Of stream, filter, map, toList
    # and get only the first is on a known type, as what the platform's methods give isn't known
    assert (cls("NOA"), cls("SIZE2"), cls("DAC"), cls("MPC"), cls("LCOM")) == (3, 3 + 4 + 11, 1, 1, 1)
    # compareTo and pick do something; getWidth and setWidth are accessors, area has no body
    assert cls("WOC") == pytest.approx(2 / 5) and method("setWidth(int)", "NOAV") == 2 and method("pick(List<? extends T>)", "CINT") == 1
    assert ("class", "shop.model.Shape.Inner", "RFC") in found and found["class", "shop.model.Shape.Inner", "RFC"] is None
    # six declared, List.stream() and new RuntimeException(..)
    assert cls("RFC") == 8
    package = lambda code, name="shop.model": found["package", name, code]
    # packages of resolved types: java.lang, java.util and java.io; an unused import is no dependency
    assert (package("PNOCC"), package("PNOAC"), package("PNOI"), package("Ce")) == (1, 1, 1, 3)
    assert package("A") == pytest.approx(2 / 3) and package("Ca", "shop.util") == 0
    assert found["project", "project", "PNOCC"] == 2 and 0 <= found["project", "project", "PRMI"] <= 100
    assert not any("Skipped" in e for _, e, _ in found)


def test_coverage_and_extension(analysis):
    row = java_names.coverage(analysis.tables).first()
    assert 0 < row.coverage <= 1 and row.resolved <= row.attempts
    with pytest.raises(ValueError):
        java_metrics.register_metric("CC", "method", lambda t: None)
    java_metrics.register_metric("NOP_TEST", "class", lambda t: t["classes"].selectExpr("class as entity_id", "package as parent_id", "1L as value"))
    java_metrics._EXTRA.clear()


def test_diagnostics_and_unsupported(analysis):
    assert [r.kind for r in analysis.tables["diagnostics"].collect()] == ["PARSE_FAILED"]
    assert sorted(r.kind for r in analysis.tables["unsupported"].collect()) == ["enum", "record"]
