"""A structural parser for Java: declarations, statements and expressions as nodes.

It reads what the syntax-local metrics need. Nodes have a kind, attributes, children and lines. Constructs it
doesn't model in detail (annotations' arguments, type bounds) are read over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quarry.sources.java_lexer import PRIMITIVES, Token, lex

MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
#: Binding strength of binary operators, weakest first.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class ParseError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    line: int
    end: int = 0
    name: str = ""
    op: str = ""
    type: str = ""
    modifiers: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()
    extends: tuple[str, ...] = ()
    implements: tuple[str, ...] = ()
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)

    def find(self, *kinds: str) -> list[Node]:
        return [n for n in self.walk() if n.kind in kinds]

    def child(self, kind: str) -> Node | None:
        return next((c for c in self.children if c.kind == kind), None)


class Parser:
    def __init__(self, text: str):
        self.tokens = lex(text)
        self.at = 0
        self.eof = Token("eof", "", self.tokens[-1].line if self.tokens else 1)

    # -- reading tokens -------------------------------------------------------------------------------------------
    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else self.eof

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def sees(self, *texts: str) -> bool:
        token = self.peek()
        return token.text in texts and token.kind not in ("string", "char", "block")

    def take(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.sees(text):
            raise ParseError(f"line {self.peek().line}: expected {text!r}, found {self.peek().text!r}")
        return self.next()

    def name(self) -> str:
        token = self.next()
        if token.kind != "name":
            raise ParseError(f"line {token.line}: expected a name, found {token.text!r}")
        return token.text

    def done(self, node: Node) -> Node:
        node.end = self.tokens[max(0, min(self.at, len(self.tokens)) - 1)].line if self.tokens else node.line
        return node

    # -- names and types ------------------------------------------------------------------------------------------
    def qualified(self) -> str:
        out = self.name()
        while self.sees(".") and self.peek(1).kind == "name":
            self.next()
            out += "." + self.name()
        return out

    def skip_balanced(self, opening: str, closing: str) -> None:
        self.need(opening)
        depth = 1
        while depth:
            token = self.next()
            if token.kind == "eof":
                raise ParseError(f"line {token.line}: {opening!r} isn't closed")
            if token.kind == "op":
                depth += (token.text == opening) - (token.text == closing)

    def annotation(self) -> str:
        self.need("@")
        name = self.qualified()
        if self.sees("("):
            self.skip_balanced("(", ")")
        return name

    def type(self) -> str:
        """The type's text without annotations; raises if there is none."""
        while self.sees("@"):
            self.annotation()
        token = self.peek()
        if token.text in PRIMITIVES or token.text == "?":
            out = self.next().text
            if out == "?" and self.sees("extends", "super"):
                out += f" {self.next().text} {self.type()}"
        else:
            out = self.name() + self.type_arguments()
            while self.sees(".") and (self.peek(1).kind == "name" or self.peek(1).text == "@"):
                self.next()
                while self.sees("@"):
                    self.annotation()
                out += "." + self.name() + self.type_arguments()
        while self.sees("[") and self.peek(1).text == "]":
            self.at += 2
            out += "[]"
        return out

    def type_arguments(self) -> str:
        if not self.sees("<"):
            return ""
        self.next()
        parts = []
        while not self.sees(">"):
            part = self.type()
            while self.take("&"):
                part += " & " + self.type()
            parts.append(part)
            if not self.take(","):
                break
        self.need(">")
        return f"<{', '.join(parts)}>"

    def type_parameters(self) -> None:
        if self.sees("<"):
            self.skip_balanced("<", ">")

    def is_type(self, then: tuple[str, ...] | None = None) -> bool:
        """Whether a type starts here, followed by a name (or by one of ``then``)."""
        start = self.at
        try:
            self.type()
            token = self.peek()
            return token.text in then if then else token.kind == "name" or token.text == "..."
        except ParseError:
            return False
        finally:
            self.at = start

    # -- declarations ---------------------------------------------------------------------------------------------
    def unit(self) -> Node:
        unit = Node("unit", 1)
        mark = self.at
        while self.sees("@") and self.peek(1).text != "interface":
            self.annotation()
        if self.take("package"):
            unit.name = self.qualified()
            self.need(";")
        else:
            self.at = mark
        while self.peek().kind != "eof":
            if self.take(";"):
                continue
            if self.sees("import"):
                line = self.next().line
                static = self.take("static")
                name = self.qualified()
                wild = self.take(".") and self.take("*")
                self.need(";")
                unit.children.append(Node("import", line, line, name, op="*" if wild else "", modifiers=("static",) if static else ()))
            elif self.sees("module", "open") and self.peek(1).kind == "name":
                while not self.sees("{"):
                    self.next()
                unit.children.append(Node("module", self.peek().line))
                self.skip_balanced("{", "}")
            else:
                unit.children.append(self.member(""))
        return self.done(unit)

    def modifiers(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        words, marks = [], []
        while True:
            if self.sees("@") and self.peek(1).text != "interface":
                marks.append(self.annotation())
            elif self.sees("non") and self.peek(1).text == "-" and self.peek(2).text == "sealed":
                self.at += 3
                words.append("non-sealed")
            elif self.peek().text in MODIFIERS and not (self.sees("default") and self.peek(1).text in (":", "->")) and not (self.sees("sealed") and self.peek(1).text in ("(", "=", ".")):
                words.append(self.next().text)
            else:
                return tuple(words), tuple(marks)

    def member(self, owner: str) -> Node:
        line = self.peek().line
        words, marks = self.modifiers()
        if self.sees("{"):
            node = Node("initializer", line, modifiers=words, children=[self.block()])
            return self.done(node)
        if self.sees("class", "interface", "enum") or self.sees("@") or self.sees("record") and self.peek(1).kind == "name" and self.peek(2).text in ("(", "<"):
            return self.declaration(line, words, marks)
        self.type_parameters()
        words2, marks2 = self.modifiers()
        words, marks = words + words2, marks + marks2
        if self.peek().kind == "name" and self.peek().text == owner.rpartition(".")[2] and self.peek(1).text in ("(", "{"):
            return self.method(Node("constructor", line, name=self.name(), modifiers=words, annotations=marks))
        type_ = self.type()
        name = self.name()
        if self.sees("("):
            return self.method(Node("method", line, name=name, type=type_, modifiers=words, annotations=marks))
        node = Node("field", line, name=name, type=type_, modifiers=words, annotations=marks)
        self.variables(node, name, type_)
        self.need(";")
        return self.done(node)

    def declaration(self, line: int, words: tuple[str, ...], marks: tuple[str, ...]) -> Node:
        kind = "annotation" if self.take("@") else self.next().text
        if kind == "annotation":
            self.need("interface")
        node = Node(kind, line, name=self.name(), modifiers=words, annotations=marks)
        self.type_parameters()
        if kind == "record":
            self.parameters(node)
        while self.sees("extends", "implements", "permits"):
            word = self.next().text
            names = [self.type()]
            while self.take(","):
                names.append(self.type())
            if word == "extends":
                node.extends = tuple(names)
            elif word == "implements":
                node.implements = tuple(names)
        self.body(node)
        return self.done(node)

    def body(self, node: Node) -> None:
        self.need("{")
        if node.kind == "enum":
            while self.peek().kind == "name" or self.sees("@"):
                while self.sees("@"):
                    self.annotation()
                constant = Node("constant", self.peek().line, name=self.name())
                if self.sees("("):
                    constant.children += self.arguments()
                if self.sees("{"):
                    self.body(constant)
                node.children.append(self.done(constant))
                if not self.take(","):
                    break
            self.take(";")
        while not self.sees("}"):
            if self.take(";"):
                continue
            node.children.append(self.member(node.name))
        self.need("}")

    def parameters(self, node: Node) -> None:
        self.need("(")
        while not self.sees(")"):
            line = self.peek().line
            words, _ = self.modifiers()
            type_ = self.type()
            if self.take("..."):
                type_ += "..."
            if self.take("this"):  # a receiver isn't a parameter
                pass
            else:
                name = self.name()
                while self.take("."):
                    self.next()
                while self.take("["):
                    self.need("]")
                    type_ += "[]"
                node.children.append(Node("parameter", line, line, name, type=type_, modifiers=words))
            if not self.take(","):
                break
        self.need(")")

    def method(self, node: Node) -> Node:
        if self.sees("("):
            self.parameters(node)
        while self.take("["):
            self.need("]")
        if self.take("throws"):
            thrown = [self.type()]
            while self.take(","):
                thrown.append(self.type())
            node.implements = tuple(thrown)
        if self.take("default"):
            node.children.append(self.element())
        if self.sees("{"):
            node.children.append(self.block())
        else:
            self.need(";")
        return self.done(node)

    def element(self) -> Node:
        if self.sees("{"):
            line = self.peek().line
            self.skip_balanced("{", "}")
            return Node("array", line, line)
        if self.sees("@"):
            line = self.peek().line
            return Node("annotation-value", line, line, self.annotation())
        return self.expression()

    def variables(self, node: Node, name: str, type_: str) -> None:
        while True:
            variable = Node("variable", self.peek().line, name=name, type=type_)
            while self.take("["):
                self.need("]")
                variable.type += "[]"
            if self.take("="):
                variable.children.append(self.initial())
            node.children.append(self.done(variable))
            if not self.take(","):
                return
            name = self.name()

    def initial(self) -> Node:
        if not self.sees("{"):
            return self.expression()
        node = Node("array", self.next().line)
        while not self.sees("}"):
            node.children.append(self.initial())
            if not self.take(","):
                break
        self.need("}")
        return self.done(node)

    # -- statements -----------------------------------------------------------------------------------------------
    def block(self) -> Node:
        node = Node("block", self.need("{").line)
        while not self.sees("}"):
            if self.peek().kind == "eof":
                raise ParseError(f"line {self.peek().line}: a block isn't closed")
            node.children.append(self.statement())
        self.need("}")
        return self.done(node)

    def statement(self) -> Node:
        token = self.peek()
        reader = getattr(self, f"_{token.text}", None) if token.kind == "keyword" else None
        if token.text == "{" and token.kind == "op":
            return self.block()
        if reader is not None:
            return self.done(reader(Node(token.text, token.line)))
        if self.take(";"):
            return Node("empty", token.line, token.line)
        if token.text == "yield" and self.peek(1).text not in ("=", ".", "(", "++", "--", "["):
            self.next()
            node = Node("yield", token.line, children=[self.expression()])
            self.need(";")
            return self.done(node)
        if token.kind == "name" and self.peek(1).text == ":":
            self.at += 2
            return self.done(Node("label", token.line, name=token.text, children=[self.statement()]))
        mark = self.at
        words, marks = self.modifiers()
        if self.sees("class", "interface", "enum") or self.sees("record") and self.peek(1).kind == "name" and self.peek(2).text in ("(", "<"):
            return Node("local-class", token.line, token.line, children=[self.declaration(token.line, words, marks)])
        if self.is_type():
            node = self.locals(token.line, words)
            self.need(";")
            return self.done(node)
        self.at = mark
        node = Node("expression", token.line, children=[self.expression()])
        self.need(";")
        return self.done(node)

    def locals(self, line: int, words: tuple[str, ...]) -> Node:
        type_ = self.type()
        node = Node("locals", line, type=type_, modifiers=words)
        self.variables(node, self.name(), type_)
        return self.done(node)

    def condition(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def _if(self, node: Node) -> Node:
        self.next()
        node.children = [self.condition(), self.statement()]
        if self.take("else"):
            node.op = "else"
            node.children.append(self.statement())
        return node

    def _while(self, node: Node) -> Node:
        self.next()
        node.children = [self.condition(), self.statement()]
        return node

    def _do(self, node: Node) -> Node:
        self.next()
        node.children = [self.statement()]
        self.need("while")
        node.children.append(self.condition())
        self.need(";")
        return node

    def _for(self, node: Node) -> Node:
        self.next()
        self.need("(")
        mark = self.at
        words, _ = self.modifiers()
        if self.is_type():
            type_, name = self.type(), self.name()
            if self.take(":"):
                node.kind = "foreach"
                node.children = [Node("locals", node.line, node.line, type=type_, children=[Node("variable", node.line, node.line, name, type=type_)]), self.expression()]
                self.need(")")
                node.children.append(self.statement())
                return node
            self.at = mark
            words, _ = self.modifiers()
            node.children.append(Node("for-init", node.line, node.line, children=[self.locals(node.line, words)]))
        elif not self.sees(";"):
            node.children.append(Node("for-init", node.line, node.line, children=self.expressions()))
        self.need(";")
        if not self.sees(";"):
            node.children.append(self.expression())
        self.need(";")
        if not self.sees(")"):
            node.children.append(Node("for-update", node.line, node.line, children=self.expressions()))
        self.need(")")
        node.children.append(self.statement())
        return node

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def _switch(self, node: Node) -> Node:
        mark = self.at
        self.next()
        node.children = [self.condition()]
        self.entries(node)
        if self.sees(".", ";") and self.peek().text == ".":  # a switch expression used as a statement's start
            self.at = mark
            inner = Node("expression", node.line, children=[self.expression()])
            self.need(";")
            return inner
        return node

    def entries(self, node: Node) -> None:
        self.need("{")
        while not self.sees("}"):
            entry = Node("entry", self.peek().line)
            if self.take("default"):
                entry.op = "default"
            else:
                self.need("case")
                while True:
                    if self.take("default"):
                        entry.op = "default"
                    elif self.is_type():
                        entry.children.append(Node("pattern", self.peek().line, type=self.type(), name=self.name()))
                    elif self.is_type(("(",)) and self.peek().text[:1].isupper():
                        entry.children.append(Node("pattern", self.peek().line, type=self.type()))
                        self.skip_balanced("(", ")")
                    else:
                        entry.children.append(self.ternary())
                    if not self.take(","):
                        break
                if self.take("when"):
                    entry.children.append(self.expression())
            if self.take("->"):
                if self.sees("{"):
                    entry.children.append(self.block())
                elif self.sees("throw"):
                    entry.children.append(self.statement())
                else:
                    inner = Node("expression", self.peek().line, children=[self.expression()])
                    self.need(";")
                    entry.children.append(self.done(inner))
            else:
                self.need(":")
                while not self.sees("case", "default", "}"):
                    entry.children.append(self.statement())
            node.children.append(self.done(entry))
        self.need("}")

    def _try(self, node: Node) -> Node:
        self.next()
        if self.take("("):
            while not self.sees(")"):
                mark = self.at
                words, _ = self.modifiers()
                if self.is_type():
                    node.children.append(self.locals(self.peek().line, words))
                else:
                    self.at = mark
                    node.children.append(self.expression())
                if not self.take(";"):
                    break
            self.need(")")
        node.children.append(self.block())
        while self.sees("catch"):
            catch = Node("catch", self.next().line)
            self.need("(")
            self.modifiers()
            catch.type = self.type()
            while self.take("|"):
                catch.type += " | " + self.type()
            catch.name = self.name()
            self.need(")")
            catch.children = [self.block()]
            node.children.append(self.done(catch))
        if self.take("finally"):
            node.op = "finally"
            node.children.append(self.block())
        return node

    def _jump(self, node: Node) -> Node:
        self.next()
        if self.peek().kind == "name":
            node.name = self.name()
        self.need(";")
        return node

    _break = _continue = _jump

    def _return(self, node: Node) -> Node:
        self.next()
        if not self.sees(";"):
            node.children = [self.expression()]
        self.need(";")
        return node

    def _throw(self, node: Node) -> Node:
        return self._return(node)

    def _synchronized(self, node: Node) -> Node:
        self.next()
        node.children = [self.condition(), self.block()]
        return node

    def _assert(self, node: Node) -> Node:
        self.next()
        node.children = [self.expression()]
        if self.take(":"):
            node.children.append(self.expression())
        self.need(";")
        return node

    # -- expressions ----------------------------------------------------------------------------------------------
    def expression(self) -> Node:
        if self.is_lambda():
            return self.lambda_()
        left = self.ternary()
        op = self.operator(ASSIGN)
        if op:
            return self.done(Node("assign", left.line, op=op, children=[left, self.expression()]))
        return left

    def operator(self, wanted: frozenset | tuple) -> str:
        """Takes and returns an operator; ``>`` tokens that touch are one."""
        token = self.peek()
        if token.kind not in ("op", "keyword"):
            return ""
        text, used = token.text, 1
        if text == ">":
            while self.peek(used).text in (">", ">=", "=") and used < 4 and not text.endswith("="):
                text += self.peek(used).text
                used += 1
            while text and text not in wanted and used > 1:
                used -= 1
                text = ">" * used
            if text == ">" and self.peek(1).text in (">", ">="):
                return ""
        if text in wanted:
            self.at += used
            return text
        return ""

    def ternary(self) -> Node:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.lambda_() if self.is_lambda() else self.ternary_or_assign()
        self.need(":")
        no = self.lambda_() if self.is_lambda() else self.ternary()
        return self.done(Node("ternary", test.line, children=[test, yes, no]))

    def ternary_or_assign(self) -> Node:
        return self.expression()

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.operator(LEVELS[level]):
            if op == "instanceof":
                self.take("final")
                type_ = self.type()
                if self.sees("("):
                    self.skip_balanced("(", ")")
                bound = self.name() if self.peek().kind == "name" and self.peek().text != "when" else ""
                left = self.done(Node("instanceof", left.line, name=bound, type=type_, children=[left]))
            else:
                left = self.done(Node("binary", left.line, op=op, children=[left, self.binary(level + 1)]))
        return left

    def unary(self) -> Node:
        token = self.peek()
        if token.kind == "op" and token.text in ("+", "-", "!", "~", "++", "--"):
            self.next()
            return self.done(Node("unary", token.line, op=token.text, children=[self.unary()]))
        if self.sees("(") and self.is_cast():
            self.next()
            type_ = self.type()
            while self.take("&"):
                self.type()
            self.need(")")
            inner = self.lambda_() if self.is_lambda() else self.unary()
            return self.done(Node("cast", token.line, type=type_, children=[inner]))
        node = self.postfix(self.primary())
        while self.sees("++", "--"):
            node = Node("unary", node.line, op=f"post{self.next().text}", children=[node])
        return node

    def is_cast(self) -> bool:
        start = self.at
        try:
            self.next()
            primitive = self.peek().text in PRIMITIVES
            self.type()
            while self.take("&"):
                self.type()
            if not self.take(")"):
                return False
            token = self.peek()
            return primitive or token.kind in ("name", "string", "char", "block", "number", "long") or token.text in ("(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or token.text in PRIMITIVES
        except ParseError:
            return False
        finally:
            self.at = start

    def is_lambda(self) -> bool:
        if self.peek().kind == "name" and self.peek(1).text == "->":
            return True
        if not self.sees("("):
            return False
        depth, i = 0, 0
        while True:
            token = self.peek(i)
            if token.kind == "eof":
                return False
            if token.kind == "op":
                depth += (token.text == "(") - (token.text == ")")
            i += 1
            if not depth:
                return self.peek(i).text == "->"

    def lambda_(self) -> Node:
        node = Node("lambda", self.peek().line)
        if self.peek().kind == "name":
            node.children.append(Node("lambda-parameter", node.line, node.line, self.name()))
        else:
            self.need("(")
            while not self.sees(")"):
                self.modifiers()
                type_ = ""
                if self.is_type():
                    type_ = self.type()
                    self.take("...")
                node.children.append(Node("lambda-parameter", node.line, node.line, self.name(), type=type_))
                if not self.take(","):
                    break
            self.need(")")
        self.need("->")
        if self.sees("{"):
            node.children.append(self.block())
        else:
            node.op = "expression"
            node.children.append(self.expression())
        return self.done(node)

    def arguments(self) -> list[Node]:
        self.need("(")
        out = [] if self.sees(")") else self.expressions()
        self.need(")")
        return out

    def primary(self) -> Node:
        token = self.peek()
        line = token.line
        if token.kind in ("number", "long", "char", "string", "block"):
            self.next()
            return Node("literal", line, line, token.text, op=token.kind)
        if self.sees("true", "false", "null"):
            return Node("literal", line, line, self.next().text, op="null" if token.text == "null" else "boolean")
        if self.take("("):
            node = Node("parenthesis", line, children=[self.expression()])
            self.need(")")
            return self.done(node)
        if self.sees("this", "super"):
            word = self.next().text
            if self.sees("("):
                return self.done(Node("explicit-call", line, name=word, children=self.arguments()))
            return Node(word, line, line, word)
        if self.take("new"):
            return self.creation(line)
        if self.sees("switch"):
            self.next()
            node = Node("switch-expression", line, children=[self.condition()])
            self.entries(node)
            return self.done(node)
        if token.text in PRIMITIVES or self.is_type(("::",)) and self.peek(1).text in ("<", "["):
            return Node("type", line, line, self.type())
        if token.kind == "name":
            if self.peek(1).text == "[" and self.peek(2).text == "]":
                return Node("type", line, line, self.type())
            name = self.name()
            if self.sees("("):
                return self.done(Node("call", line, name=name, children=self.arguments()))
            return Node("name", line, line, name)
        raise ParseError(f"line {line}: expected an expression, found {token.text!r}")

    def creation(self, line: int) -> Node:
        while self.sees("@"):
            self.annotation()
        type_ = self.next().text if self.peek().text in PRIMITIVES else self.qualified()
        if self.sees("<"):
            self.skip_balanced("<", ">")
            while self.take("."):
                type_ += "." + self.name()
                if self.sees("<"):
                    self.skip_balanced("<", ">")
        node = Node("new", line, type=type_)
        if self.sees("["):
            node.kind = "new-array"
            while self.take("["):
                if not self.sees("]"):
                    node.children.append(self.expression())
                self.need("]")
            if self.sees("{"):
                node.children.append(self.initial())
            return self.done(node)
        node.children = self.arguments()
        if self.sees("{"):
            body = Node("anonymous", self.peek().line)
            self.body(body)
            node.children.append(self.done(body))
        return self.done(node)

    def postfix(self, node: Node) -> Node:
        while True:
            if self.sees("."):
                self.next()
                if self.take("new"):
                    inner = self.creation(node.line)
                    inner.children.insert(0, node)
                    node = inner
                    continue
                if self.sees("<"):
                    self.skip_balanced("<", ">")
                if self.sees("this", "super", "class"):
                    word = self.next().text
                    node = self.done(Node("field-access" if word != "class" else "class-literal", node.line, name=word, children=[node]))
                    continue
                name = self.name()
                if self.sees("("):
                    node = self.done(Node("call", node.line, name=name, op=".", children=[node, *self.arguments()]))
                else:
                    node = self.done(Node("field-access", node.line, name=name, children=[node]))
            elif self.sees("["):
                self.next()
                node = Node("index", node.line, children=[node, self.expression()])
                self.need("]")
                self.done(node)
            elif self.sees("::"):
                self.next()
                if self.sees("<"):
                    self.skip_balanced("<", ">")
                node = self.done(Node("method-reference", node.line, name=self.next().text, children=[node]))
            elif self.sees("<") and node.kind == "name" and self.generic_reference():
                continue
            else:
                return node

    def generic_reference(self) -> bool:
        """Reads over the type arguments of ``Name<...>::member``."""
        start = self.at
        try:
            self.type_arguments()
            if self.sees("::"):
                return True
        except ParseError:
            pass
        self.at = start
        return False


def parse(text: str) -> Node:
    """The compilation unit of a source text; LexError or ParseError if it can't be read."""
    return Parser(text).unit()
