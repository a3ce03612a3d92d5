"""A compiler for a small, sandboxed template language for conversations.

    text                          is copied
    {{ expression }}              writes a value; none writes nothing
    {% for x in expression %}     ... {% endfor %}, with loop.index, index0, first, last, length, previous, next
    {% if expression %}           ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %}              ... {% endgeneration %}: what is written here is what the model is to learn
    {# comment #}                 and a minus inside a tag drops the white space beside it

Expressions have strings, integers, true, false, none, names, x.key, x['key'], x[0], + - * ~, comparisons, in, not in, is
none, and, or, not, a if c else b, and filters: x | name(arguments). There are no calls, no loops without a list, and
no way to Python's attributes: keys are looked up in dictionaries and lists alone, unknown ones give none.

Source text becomes a syntax tree, constant parts of the tree are folded, and every node becomes a Python closure.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template can't be compiled."""


# syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple


@dataclass(frozen=True)
class Write:
    of: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: Block
    other: Block


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: Block


@dataclass(frozen=True)
class Assign:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: Block


# parser

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~<>.,|()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_COMPARE = ("==", "!=", "<", ">", "<=", ">=")


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        text = m[kind]
        if kind == "str":
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif kind == "int":
            out.append(("const", int(text)))
        elif kind == "name" and text in _WORDS:
            out.append(("const", _WORDS[text]))
        else:
            out.append((kind, text))
    return out


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def whole(self) -> Any:
        out = self.choice()
        self.end()
        return out

    def choice(self) -> Any:
        then = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, then, self.choice() if self.take("else") else Const(None))
        return then

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.sum()
        while True:
            if op := self.take(*_COMPARE, "in"):
                left = Binary(op, left, self.sum())
            elif self.take("is"):
                negative = bool(self.take("not"))
                if self.at >= len(self.tokens) or self.tokens[self.at] != ("const", None):
                    raise TemplateError("only 'is none' and 'is not none' are known")
                self.at += 1
                left = Binary("!=" if negative else "==", left, Const(None))
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                left = Unary("not", Binary("in", left, self.sum()))
            else:
                return left

    def sum(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "-", "*", "~"):
            left = Binary(op, left, self.filtered())
        return left

    def filtered(self) -> Any:
        left = self.path()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.peek(")"):
                        self.need(",")
            left = Filter(name, left, tuple(args))
        return left

    def path(self) -> Any:
        left = self.atom()
        while True:
            if self.take("."):
                left = Item(left, Const(self.name()))
            elif self.take("["):
                left = Item(left, self.choice())
                self.need("]")
            else:
                return left

    def atom(self) -> Any:
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        if self.take("-"):
            return Unary("-", self.path())
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.name())


def parse(source: str) -> Block:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        if m[1] or m[4] or m[7]:
            text = text.rstrip()
        pieces.append(("text", text))
        if m[2] is not None:
            pieces.append(("write", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
    rest = source[at:].lstrip() if strip else source[at:]
    pieces.append(("text", rest))
    body, end = _block(pieces, 0, ())
    if end != len(pieces):
        raise TemplateError(f"{pieces[end][1]!r} has no beginning")
    return body


def _block(pieces: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[Block, int]:
    """The nodes up to a tag that starts with one of `ends`, and that tag's place."""
    out: list[Any] = []
    while at < len(pieces):
        kind, text = pieces[at]
        word = text.split(None, 1)[0] if kind == "tag" and text else ""
        if kind == "text":
            if text:
                out.append(Write(Const(text)))
        elif kind == "write":
            out.append(Write(_Expression(text).whole()))
        elif word in ends:
            return Block(tuple(out)), at
        elif word == "set":
            e = _Expression(text[3:])
            name = e.name()
            e.need("=")
            out.append(Assign(name, e.whole()))
        elif word == "for":
            e = _Expression(text[3:])
            name = e.name()
            e.need("in")
            body, at = _block(pieces, at + 1, ("endfor",))
            _ended(pieces, at, "endfor")
            out.append(For(name, e.whole(), body))
        elif word == "generation":
            body, at = _block(pieces, at + 1, ("endgeneration",))
            _ended(pieces, at, "endgeneration")
            out.append(Generation(body))
        elif word == "if":
            node, at = _if(pieces, at, text[2:])
            out.append(node)
        else:
            raise TemplateError(f"unknown tag {text!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return Block(tuple(out)), at


def _if(pieces: list[tuple[str, str]], at: int, test: str) -> tuple[If, int]:
    then, at = _block(pieces, at + 1, ("elif", "else", "endif"))
    _ended(pieces, at, "endif")
    text = pieces[at][1]
    if text.startswith("elif"):
        other, at = _if(pieces, at, text[4:])
        return If(_Expression(test).whole(), then, Block((other,))), at
    other = Block(())
    if text == "else":
        other, at = _block(pieces, at + 1, ("endif",))
        _ended(pieces, at, "endif")
    return If(_Expression(test).whole(), then, other), at


def _ended(pieces: list[tuple[str, str]], at: int, what: str) -> None:
    if at >= len(pieces):
        raise TemplateError(f"{what!r} is missing")


# values


def text_of(value: Any) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) or isinstance(b, str):
        return text_of(a) + text_of(b)
    return (a or 0) + (b or 0)


def _times(a: Any, b: Any) -> int:
    if isinstance(a, int) and isinstance(b, int):
        return a * b
    raise TemplateError("only numbers are multiplied")


def _order(op: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: type(a) is type(b) and op(a, b)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": _add, "-": lambda a, b: (a or 0) - (b or 0), "*": _times, "~": lambda a, b: text_of(a) + text_of(b),
    "==": operator.eq, "!=": operator.ne, "<": _order(operator.lt), ">": _order(operator.gt), "<=": _order(operator.le), ">=": _order(operator.ge),
    "in": lambda a, b: a in b if isinstance(b, (list, tuple, dict)) or isinstance(a, str) and isinstance(b, str) else False,
}

FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "string": text_of,
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, y="": y if x is None else x,
    "replace": lambda x, a, b: text_of(x).replace(text_of(a), text_of(b)),
    "join": lambda x, y="": text_of(y).join(text_of(v) for v in x) if isinstance(x, (list, tuple)) else text_of(x),
    "first": lambda x: _item(x, 0),
    "last": lambda x: _item(x, -1),
}


# constants


def fold(node: Any, filters: dict[str, Callable[..., Any]]) -> Any:
    """The tree with everything computed that doesn't depend on data: operators and filters on constants, branches
    with constant tests, and texts that are written one after the other."""

    def go(n: Any) -> Any:
        return fold(n, filters)

    if isinstance(node, Item):
        of, key = go(node.of), go(node.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Unary):
        of = go(node.of)
        return Const(_unary(node.op)(of.value)) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Binary):
        left, right = go(node.left), go(node.right)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        if node.op in _BINARY and isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Choice):
        test = go(node.test)
        return go(node.then if test.value else node.other) if isinstance(test, Const) else Choice(test, go(node.then), go(node.other))
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of, args = go(node.of), tuple(map(go, node.args))
        if isinstance(of, Const) and all(isinstance(a, Const) for a in args):
            return Const(filters[node.name](of.value, *(a.value for a in args)))
        return Filter(node.name, of, args)
    if isinstance(node, Write):
        of = go(node.of)
        return Write(Const(text_of(of.value))) if isinstance(of, Const) else Write(of)
    if isinstance(node, Block):
        out: list[Any] = []
        for part in map(go, node.parts):
            for one in part.parts if isinstance(part, Block) else (part,):
                constant = isinstance(one, Write) and isinstance(one.of, Const)
                if constant and not one.of.value:
                    continue
                if constant and out and isinstance(out[-1], Write) and isinstance(out[-1].of, Const):
                    out[-1] = Write(Const(out[-1].of.value + one.of.value))
                else:
                    out.append(one)
        return Block(tuple(out))
    if isinstance(node, If):
        test = go(node.test)
        return go(node.then if test.value else node.other) if isinstance(test, Const) else If(test, go(node.then), go(node.other))
    if isinstance(node, For):
        return For(node.name, go(node.of), go(node.body))
    if isinstance(node, Assign):
        return Assign(node.name, go(node.of))
    if isinstance(node, Generation):
        return Generation(go(node.body))
    return node


def _unary(op: str) -> Callable[[Any], Any]:
    return operator.not_ if op == "not" else lambda x: -(x or 0)


# closures


@dataclass
class Page:
    """What is written: parts, their length so far, and the spans that were written inside `generation`."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any, filters: dict[str, Callable[..., Any]]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Unary):
        of, op = _value(node.of, filters), _unary(node.op)
        return lambda env: op(of(env))
    if isinstance(node, Binary):
        left, right = _value(node.left, filters), _value(node.right, filters)
        if node.op == "and":
            return lambda env: left(env) and right(env)
        if node.op == "or":
            return lambda env: left(env) or right(env)
        op = _BINARY[node.op]
        return lambda env: op(left(env), right(env))
    if isinstance(node, Choice):
        test, then, other = (_value(n, filters) for n in (node.test, node.then, node.other))
        return lambda env: then(env) if test(env) else other(env)
    fn, of = filters[node.name], _value(node.of, filters)
    args = [_value(a, filters) for a in node.args]
    return lambda env: fn(of(env), *(a(env) for a in args))


def _writer(node: Any, filters: dict[str, Callable[..., Any]], learning: bool = False) -> Callable[[dict, Page], None]:
    if isinstance(node, Write):
        if isinstance(node.of, Const):
            return lambda env, page, t=node.of.value: page.write(t)
        of = _value(node.of, filters)
        return lambda env, page: page.write(text_of(of(env)))
    if isinstance(node, Block):
        parts = [_writer(p, filters, learning) for p in node.parts]

        def block(env: dict, page: Page) -> None:
            for part in parts:
                part(env, page)

        return block
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _writer(node.then, filters, learning), _writer(node.other, filters, learning)
        return lambda env, page: then(env, page) if test(env) else other(env, page)
    if isinstance(node, Assign):
        of = _value(node.of, filters)
        return lambda env, page, n=node.name: env.__setitem__(n, of(env))
    if isinstance(node, Generation):
        if learning:
            raise TemplateError("generation inside generation")
        inner = _writer(node.body, filters, True)

        def generation(env: dict, page: Page) -> None:
            start = page.size
            inner(env, page)
            page.spans.append((start, page.size))

        return generation
    of, body = _value(node.of, filters), _writer(node.body, filters, learning)

    def loop(env: dict, page: Page) -> None:
        items = of(env)
        if not isinstance(items, (list, tuple)):
            return
        n = len(items)
        for k, item in enumerate(items):
            state = {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n, "previous": items[k - 1] if k else None, "next": items[k + 1] if k + 1 < n else None}
            body({**env, node.name: item, "loop": state}, page)

    return loop


def compile_template(source: str, filters: dict[str, Callable[..., Any]] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans written inside `generation`, in code points)."""
    known = {**FILTERS, **(filters or {})}
    write = _writer(fold(parse(source), known), known)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        write(dict(variables), page)
        return "".join(page.parts), page.spans

    return render
