"""Java sources as tables: files, declarations, syntax nodes, tokens and diagnostics.

Files are read as binary rows; exclusions are applied to paths before anything is parsed. Parsing runs inside
Arrow batches on the executors and yields one wide stream of rows, told apart by ``row``; it is stored once,
a folder for each kind of row, and the tables read their folders. Each class or interface, nested and local ones
too, is analysed by itself; a method's rows hold everything inside it, so those of a local class appear under both.

Rows of kind ``access`` are names, field accesses and calls as chains: where the chain begins (``origin``) and its
``steps``, ``f:name`` for a field, ``c:name/arity`` for a call, ``i`` for an index. Local variables and parameters are
replaced by their declared types while parsing, so that chains need no scopes afterwards.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.sources.java_lexer import PRIMITIVES, LexError
from quarry.sources.java_parser import Node, ParseError, parse

SCHEMA = (
    "row string, path string, package string, class string, class_kind string, member string, member_kind string, name string, modifiers array<string>, annotations array<string>, "
    "type string, kind string, op string, line long, end_line long, body_line long, body_end long, params long, d_cond long, d_loop long, d_nest long, d_cog long, supers array<string>, interfaces array<string>, "
    "extends_types array<string>, implements_types array<string>, origin string, steps array<string>"
)
CONDITIONS, LOOPS = frozenset(["if", "switch", "catch", "ternary"]), frozenset(["for", "foreach", "while", "do"])
COGNITIVE = CONDITIONS | LOOPS | {"lambda"}
NAMES = re.compile(r"[^\W\d][\w$]*")


def root_problems(roots: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """The readable local roots, nested and repeated ones left out, and (path, kind, name) for those that are missing.

    Roots with a scheme (``s3a://``, ``hdfs://``) are taken as they are. An explicit file must be a .java file.
    """
    good, bad = [], []
    for root in dict.fromkeys(r.rstrip("/") or "/" for r in roots):
        plain = root.removeprefix("file://")
        if "://" in plain:
            good.append(root)
        elif not os.path.exists(plain):
            bad.append((root, "ROOT_MISSING", "no such file or folder"))
        elif not os.access(plain, os.R_OK):
            bad.append((root, "ROOT_UNREADABLE", "can't be read"))
        elif os.path.isfile(plain) and not plain.endswith(".java"):
            bad.append((root, "NOT_JAVA", "an explicit file must end in .java"))
        else:
            good.append(root)
    inside = lambda a, b: a != b and a.removeprefix("file://").startswith(b.removeprefix("file://").rstrip("/") + "/")
    return [r for r in good if not any(inside(r, other) for other in good)], bad


def files(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """path and content of the .java files below the roots, each path once, without those whose dotted name an exclusion finds."""
    roots, _ = root_problems(roots)
    if not roots:
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(roots).select("path", "content")
    dotted = F.translate(F.regexp_replace("path", r"\.java$", ""), "/\\", "..")
    for pattern in exclude:
        found = found.filter(~dotted.rlike(pattern))
    return found


TABLES = {"classes": "class", "members": "member", "nodes": "node", "tokens": "token", "imports": "import", "unsupported": "unsupported", "diagnostics": "diagnostic", "accesses": "access", "types": "type", "files": "file"}


def tables(sources: DataFrame) -> dict[str, DataFrame]:
    """classes, members, nodes, tokens, imports, accesses, types, other declarations, files and diagnostics of source rows (path, content).

    The files are parsed once, here; what is returned reads the stored rows.
    """
    rows = graph.kept(sources.select("path", "content").mapInArrow(_parse_batches, SCHEMA), "row")
    return {table: rows.filter(F.col("row") == row).drop("row") for table, row in TABLES.items()}


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [part.split() for part in SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, types[kind]) for name, kind in fields])
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pylist(list(file_rows(path, (text or b"").decode(errors="replace"))), schema=schema)


def file_rows(path: str, text: str) -> Iterator[dict]:
    try:
        unit = parse(text)
    except (ParseError, LexError, RecursionError) as error:
        yield {"row": "diagnostic", "path": path, "kind": "PARSE_FAILED", "name": str(error)[:300]}
        return
    base = {"path": path, "package": unit.name}
    yield base | {"row": "file", "end_line": unit.end}
    for node in unit.children:
        if node.kind == "import":
            yield base | {"row": "import", "name": node.name, "op": node.op, "modifiers": list(node.modifiers), "line": node.line}
        elif node.kind == "module":
            yield base | {"row": "diagnostic", "kind": "MODULE_DESCRIPTOR", "line": node.line}
    yield from _declarations(unit, base, unit.name)


def _declarations(node: Node, base: dict, prefix: str) -> Iterator[dict]:
    for child in node.children:
        if child.kind in ("class", "interface"):
            name = f"{prefix}.{child.name}" if prefix else child.name
            yield from _class(child, base | {"class": name, "class_kind": child.kind})
            yield from _declarations(child, base, name)
        elif child.kind in ("enum", "record", "annotation"):
            name = f"{prefix}.{child.name}" if prefix else child.name
            yield base | {"row": "unsupported", "class": name, "kind": child.kind, "name": child.name, "line": child.line}
            yield from _declarations(child, base, name)
        else:
            yield from _declarations(child, base, prefix)


def _class(node: Node, base: dict) -> Iterator[dict]:
    yield base | {
        "row": "class", "name": node.name, "modifiers": list(node.modifiers), "annotations": list(node.annotations), "line": node.line, "end_line": node.end,
        "supers": [_simple(t) for t in (node.extends if node.kind == "class" else ())], "interfaces": [_simple(t) for t in (node.implements if node.kind == "class" else node.extends)],
        "extends_types": [_bare(t) for t in node.extends], "implements_types": [_bare(t) for t in node.implements],
    }
    for name in sorted(_type_names(node)):
        yield base | {"row": "type", "name": name}
    for kind, text in tokens(node):
        yield base | {"row": "token", "kind": kind, "name": text}
    for child in node.children:
        if child.kind in ("method", "constructor", "field"):
            params = [c for c in child.children if c.kind == "parameter"]
            key = f"{child.name}({', '.join(p.type for p in params)})" if child.kind != "field" else f"{child.name}@{child.line}"
            body = child.child("block")
            member = base | {"member": key, "member_kind": child.kind}
            yield member | {
                "row": "member", "name": child.name, "modifiers": list(child.modifiers), "annotations": list(child.annotations), "type": child.type, "kind": body_shape(child) if child.kind != "field" else None, "line": child.line, "end_line": child.end,
                "body_line": body and body.line, "body_end": body and body.end, "params": len(params) if child.kind != "field" else sum(c.kind == "variable" for c in child.children),
            }
            yield from _nodes(child, member)
            yield from _accesses(child, member)
            if child.kind != "field":
                for kind, text in tokens(child):
                    yield member | {"row": "token", "kind": kind, "name": text}
    inner = base | {"member": None, "member_kind": None}
    yield from _statements(node, inner)


def _nodes(root: Node, base: dict) -> Iterator[dict]:
    """One row for each node below a member, with the number of enclosing constructs; conditions count as inside."""
    stack = [(c, root, 0, 0, 0) for c in reversed(root.children)]
    while stack:
        node, parent, cond, loop, cog = stack.pop()
        own_cond, own_loop = cond + (node.kind in CONDITIONS), loop + (node.kind in LOOPS)
        kind = node.kind
        if kind == "binary" and node.op in ("&&", "||") and not (parent.kind == "binary" and parent.op == node.op):
            yield base | {"row": "node", "kind": "logical-run", "op": node.op, "line": node.line}
        name = node.name or None
        if kind == "field-access" and node.children[0].kind == "this":
            name, kind = node.name, "own-field-access"
        yield base | {
            "row": "node", "kind": kind, "op": node.op or None, "name": name, "type": node.type or None, "line": node.line, "end_line": node.end,
            "d_cond": own_cond, "d_loop": own_loop, "d_nest": own_cond + own_loop, "d_cog": cog, "params": len(node.children),
        }
        stack += [(c, node, own_cond, own_loop, cog + (node.kind in COGNITIVE)) for c in reversed(node.children)]


LITERALS = {"string": "String", "block": "String", "boolean": "boolean", "char": "char", "long": "long", "number": "int", "null": "?"}


def _accesses(root: Node, base: dict) -> Iterator[dict]:
    """One row for each name that is no local variable, field access and call below a member."""
    local: dict[str, str] = {}
    for node in root.walk():
        if node.kind in ("parameter", "variable", "lambda-parameter", "catch", "instanceof", "pattern") and node.name and not (root.kind == "field" and node in root.children):
            local.setdefault(node.name, "?" if not node.type or node.type == "var" else node.type.removesuffix("...") + "[]" * node.type.endswith("..."))
    kinds = {"name": "name", "field-access": "field", "call": "call"}
    for node in root.walk():
        if node.kind in kinds and not (node.kind == "name" and node.name in local) and not (node.kind == "field-access" and node.name in ("this", "super")):
            origin, steps = chain(node, local)
            yield base | {"row": "access", "kind": kinds[node.kind], "name": node.name, "origin": origin, "steps": steps, "line": node.line}
        elif node.kind in ("new", "explicit-call"):
            arguments = len(node.children) - sum(c.kind == "anonymous" for c in node.children)
            yield base | {"row": "access", "kind": node.kind, "name": node.type or node.name, "origin": f"type:{node.type}" if node.kind == "new" else node.name, "steps": [f"n:{arguments}"], "line": node.line}
        elif node.kind == "method-reference":
            origin, steps = chain(node.children[0], local)
            yield base | {"row": "access", "kind": "reference", "name": node.name, "origin": origin, "steps": steps or ["t:"], "line": node.line}


def chain(node: Node, local: dict[str, str]) -> tuple[str, list[str]]:
    """(origin, steps) of an expression; origins: this, super, scope (looked up by name), type:T, and ? for what isn't known."""
    steps: list[str] = []
    while True:
        kind = node.kind
        if kind == "name":
            return (f"type:{local[node.name]}", steps[::-1]) if node.name in local else ("scope", [*steps, f"f:{node.name}"][::-1])
        if kind == "call":
            steps.append(f"c:{node.name}/{len(node.children) - (node.op == '.')}")
            if node.op != ".":
                return "scope", steps[::-1]
            node = node.children[0]
        elif kind == "field-access":
            if node.name == "this" and node.children[0].kind == "name":
                return f"type:{node.children[0].name}", steps[::-1]
            if node.name != "super":
                steps.append(f"f:{node.name}")
            node = node.children[0]
        elif kind == "index":
            steps.append("i")
            node = node.children[0]
        elif kind in ("parenthesis", "assign"):
            node = node.children[0]
        elif kind == "ternary":
            node = node.children[1]
        elif kind in ("this", "super"):
            return kind, steps[::-1]
        elif kind in ("new", "cast"):
            return f"type:{node.type}", steps[::-1]
        elif kind == "literal":
            return f"type:{LITERALS.get(node.op, '?')}", steps[::-1]
        else:
            return "?", steps[::-1]


TYPE_NAMES = re.compile(r"[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*")


def _bare(type_: str) -> str:
    """A type without type arguments and dimensions."""
    return re.sub(r"<.*>", "", type_).rstrip("[].")


def _type_names(root: Node) -> set[str]:
    """The types that a class names, those in type arguments included."""
    texts = []
    for node in root.walk():
        texts += [node.type, *node.extends, *node.implements]
    return {name for text in texts if text for name in TYPE_NAMES.findall(text) if name not in PRIMITIVES and name not in ("extends", "super", "var")}


#: Nodes that count as statements.
STATEMENTS = frozenset("if switch for foreach while do return throw break continue try synchronized assert yield label expression locals local-class".split())


def _statements(root: Node, base: dict) -> Iterator[dict]:
    """Rows of kind ``statement`` for what a class itself holds: nested classes and interfaces count for themselves.

    Bodies of anonymous classes, enums and records count their statements, not their members. Statements whose nearest
    lambda is an expression don't count, nor do the variables of ``foreach`` and ``try`` headers.
    """
    stack = [(c, root, False, True) for c in reversed(root.children)]
    while stack:
        node, parent, hidden, own = stack.pop()
        if node.kind in ("class", "interface"):
            continue
        header = node.kind == "locals" and parent.kind in ("foreach", "try")
        count = node.kind in STATEMENTS and not hidden and not header
        count += (node.kind in ("if", "try") and node.op in ("else", "finally")) + (node.kind in ("entry", "catch"))
        if own and parent is root:
            count += node.kind in ("method", "constructor")
            count += sum(c.kind == "variable" for c in node.children) if node.kind == "field" else 0
        if node.kind == "for-update":
            count += len(node.children)
        if count:
            yield base | {"row": "node", "kind": "statement", "params": count, "line": node.line}
        if node.kind == "lambda":
            hidden = node.op == "expression"
        stack += [(c, node, hidden, own) for c in reversed(node.children)]


def body_shape(node: Node) -> str:
    """What a method's body amounts to: none, empty, many, or the form of its only statement."""
    body = node.child("block")
    if body is None:
        return "none"
    if len(body.children) != 1:
        return "many" if body.children else "empty"
    only = body.children[0]
    inner = only.children[0] if only.children else None
    if only.kind == "return":
        return "return-" + (inner.kind if inner is not None and inner.kind in ("name", "call") else "other" if inner is not None else "nothing")
    if only.kind == "expression" and inner.kind == "call":
        return "call"
    if only.kind == "expression" and inner.kind == "assign" and all(c.kind == "name" for c in inner.children):
        return "assign-names"
    return "other"


def _simple(type_: str) -> str:
    return type_.partition("<")[0].rpartition(".")[2].rstrip("[].")


def tokens(root: Node) -> Iterator[tuple[str, str]]:
    """(operator or operand, text) of everything below a member or class."""
    words = {"if": ["if"], "for": ["for"], "foreach": ["for"], "while": ["while"], "do": ["do", "while"], "switch": ["switch"], "switch-expression": ["switch"], "return": ["return"], "throw": ["throw"], "break": ["break"], "continue": ["continue"], "try": ["try"], "catch": ["catch"]}
    literals = {id(c) for node in root.walk() if node.kind == "class-literal" for c in node.children}
    for node in root.walk():
        kind = node.kind
        yield from (("operator", w) for w in words.get(kind, ()))
        if kind in ("class", "interface", "enum", "record"):
            yield from (("operator", name) for text in (*node.extends, *node.implements) for name in NAMES.findall(text) if name not in ("extends", "super"))
        if kind == "entry":
            labels = [c for c in node.children if c.kind not in ("block", "throw") and not (c.kind in STATEMENTS or c.kind == "empty")]
            yield from (("operator", w) for w in (["default"] if node.op == "default" else ["case"] * max(1, len(labels))))
        elif kind == "ternary":
            yield "operator", "?"
            yield "operator", ":"
        elif kind in ("binary", "unary", "assign"):
            yield "operator", node.op
        elif kind == "call":
            yield "operator", "()"
            yield "operand", node.name
        elif kind == "class-literal" and node.children[0].kind == "name":
            yield "operator", node.children[0].name
        elif kind == "name" and id(node) not in literals:
            yield "operand", node.name
        elif kind == "literal" and node.op not in ("long", "block"):
            yield "operand", node.name
        if node.type and kind in ("variable", "parameter", "method", "cast", "instanceof", "new", "new-array", "catch", "pattern", "lambda-parameter", "type"):
            for name in NAMES.findall(node.type):
                if name in PRIMITIVES or name not in ("extends", "super"):
                    yield "operator", name
        for thrown in node.implements if kind in ("method", "constructor") else ():
            yield from (("operator", name) for name in NAMES.findall(thrown))
