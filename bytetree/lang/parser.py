"""A precedence-climbing parser for schemas and path expressions."""

from __future__ import annotations

from ..errors import ExprError
from .ast import Array, Binary, Block, Call, Chain, Lit, Member, Name, Node, ScopeRef, SelfRef, Slice, Statement, Subscript, Unary
from .lexer import Token, tokenize

# Binary operators, loosest first.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
_BINDING = {op: k for k, ops in enumerate(LEVELS) for op in ops}


class Parser:
    def __init__(self, text: str, scope: Block | None = None):
        self.tokens, self.at, self.text = tokenize(text), 0, text
        self.scope = scope

    # ------------------------------------------------------------ tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, what: str) -> ExprError:
        t = self.now
        line = self.text.count("\n", 0, t.at) + 1
        return ExprError(f"line {line}: {what}, not {t.text or 'the end'!r}")

    def take(self, *texts: str) -> Token | None:
        t = self.now
        if t.kind in ("op", "keyword") and t.text in texts:
            self.at += 1
            return t
        return None

    def need(self, text: str) -> Token:
        if (t := self.take(text)) is None:
            raise self.fail(f"expected {text!r}")
        return t

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.fail("expected a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    # ------------------------------------------------------------ expressions
    def expression(self, least: int = 0, blocks: bool = True) -> Node:
        left = self.unary(blocks)
        while self.now.kind == "op" and (k := _BINDING.get(self.now.text, -1)) >= least:
            op = self.now.text
            self.at += 1
            left = Binary(op, left, self.expression(k + 1, blocks))
        return left

    def unary(self, blocks: bool) -> Node:
        if t := self.take("+", "-", "!", "~", "&", "^", "sizeof"):
            return Unary(t.text, self.unary(blocks))
        return self.chain(blocks)

    def chain(self, blocks: bool) -> Node:
        left = self.operand(blocks)
        while self.take("<>"):
            left = Chain(left, self.operand(blocks))
        return left

    def operand(self, blocks: bool) -> Node:
        if self.take("["):
            length = None if self.now.text == "]" and self.now.kind == "op" else self.expression()
            self.need("]")
            return Array(length, self.operand(blocks))
        return self.postfix(self.primary(), blocks)

    def primary(self) -> Node:
        t = self.now
        self.at += 1
        if t.kind == "number":
            return Lit(t.value)
        if t.kind == "string":
            value = t.value
            while self.now.kind == "string":
                value += self.now.value
                self.at += 1
            return Lit(value)
        if t.kind == "keyword" and t.text in ("true", "false"):
            return Lit(t.text == "true")
        if t.kind == "keyword" and t.text == "self":
            return SelfRef()
        if t.kind == "name":
            return Name(t.text, self.scope)
        if t.kind == "op" and t.text == "(":
            inner = self.expression()
            self.need(")")
            return inner
        self.at -= 1
        raise self.fail("expected an expression")

    def postfix(self, base: Node, blocks: bool) -> Node:
        while True:
            if self.take("."):
                base = Member(base, "self" if self.take("self") else self.name())
            elif self.take("::"):
                base = ScopeRef(base, "self" if self.take("self") else self.name())
            elif self.take("["):
                base = self.subscript(base)
            elif self.take("("):
                args = []
                while not self.take(")"):
                    if args:
                        self.need(",")
                    if self.now.kind == "name" and self.tokens[self.at + 1].text == "=":
                        self.at += 2
                    args.append(self.expression())
                base = Call(base, args)
            elif blocks and self.now.text == "{" and self.now.kind == "op" and isinstance(base, Name):
                base = self.block(base)
            else:
                return base

    def key(self) -> tuple[Node, Node | None]:
        k = self.expression(blocks=False)
        twin = None
        if self.take("{"):
            twin = self.expression()
            self.need("}")
        return k, twin

    def subscript(self, base: Node) -> Node:
        if self.take(".."):
            stop, twin = (None, None) if self.now.text == "]" else self.key()
            self.need("]")
            return Slice(base, None, stop, None, twin)
        start, twin = self.key()
        if self.take(".."):
            stop, other = (None, None) if self.now.text == "]" else self.key()
            self.need("]")
            return Slice(base, start, stop, twin, other)
        self.need("]")
        return Subscript(base, start, twin)

    # ------------------------------------------------------------ blocks
    def block(self, base: Node | None) -> Block:
        b = Block(base, self.scope)
        self.need("{")
        outer, self.scope = self.scope, b
        while not self.take("}"):
            self.statement(b, ())
        self.scope = outer
        return b

    def statement(self, b: Block, conds: tuple) -> None:
        if self.take(";"):
            return
        if self.take("let"):
            name = self.name()
            self.need("=")
            value = self.expression()
            if isinstance(value, Block):
                value.name = name
            b.lets.append(Statement(name, value, conds))
            self.need(";")
        elif self.take("extern"):
            b.externs.append(self.name())
            self.need(";")
        elif self.take("if"):
            self.conditional(b, conds)
        elif self.now.kind == "name" and self.tokens[self.at + 1].text == ":" and self.tokens[self.at + 1].kind == "op":
            name = self.name()
            self.need(":")
            kind = b.attrs if name[0] == "@" else b.fields
            kind.append(Statement(name, self.expression(), conds, len(kind)))
            self.need(";")
        else:
            b.fields.append(Statement(None, self.expression(), conds, len(b.fields)))
            self.need(";")

    def conditional(self, b: Block, conds: tuple) -> None:
        self.need("(")
        test = self.expression()
        self.need(")")
        self.body(b, (*conds, (test, True)))
        if self.take("else"):
            other = (*conds, (test, False))
            if self.take("if"):
                self.conditional(b, other)
            else:
                self.body(b, other)

    def body(self, b: Block, conds: tuple) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement(b, conds)

    def end(self) -> None:
        if self.now.kind != "end":
            raise self.fail("expected the end")


def parse_schema(text: str, parent: Block | None = None) -> Block:
    p = Parser(text, None)
    b = Block(None, parent)
    p.scope = b
    while p.now.kind != "end":
        p.statement(b, ())
    return b


def parse_expression(text: str, scope: Block | None = None) -> Node:
    p = Parser(text, scope)
    node = p.expression()
    p.end()
    return node
