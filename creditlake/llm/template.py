"""A sandboxed template language compiled to Python closures.

Syntax: ``{{ expr }}`` prints, ``{% for x in expr %} … {% endfor %}``, ``{% if expr %} … {% elif expr %} … {% else %} … {% endif %}``,
``{% set x = expr %}``, ``{% generation %} … {% endgeneration %}`` marks text that a model is to produce, ``{# comment #}``.
Expressions: strings, integers, ``true false none``, names, ``a.b``, ``a['b']``, ``x | filter``, ``not and or``, ``== != < <= > >= in``,
``+``, ``~`` (joins as text), parentheses and ``x if c else y``. Names reach mappings and lists only: there is no attribute access,
no call, and no loop without an end, so a template can't reach Python. Constants are folded before closures are made.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

START, STOP = object(), object()  #: generation markers in the stream that a template yields


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what the sandbox doesn't give."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    base: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    base: Any
    name: str


@dataclass(frozen=True)
class Unary:
    value: Any


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


@dataclass
class Output:
    value: Any


@dataclass
class For:
    name: str
    items: Any
    body: list


@dataclass
class If:
    branches: list = field(default_factory=list)
    other: list = field(default_factory=list)


@dataclass
class Assign:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


def text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def checked(op: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    """An operation whose wrong types are errors of the template."""

    def run(a: Any, b: Any) -> Any:
        try:
            return op(a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from e

    return run


def filtered(name: str, f: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """A filter whose wrong types are errors of the template."""

    def run(value: Any) -> Any:
        try:
            return f(value)
        except (TypeError, AttributeError) as e:
            raise TemplateError(f"{name}: {e}") from e

    return run


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": checked(operator.lt), "<=": checked(operator.le), ">": checked(operator.gt), ">=": checked(operator.ge),
    "in": checked(lambda a, b: a in b), "+": checked(operator.add), "~": lambda a, b: text(a) + text(b),
}
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))
_QUOTED = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
#: Tags end at their own mark, but not at one inside a string.
TAGS = re.compile(rf"\{{\{{((?:{_QUOTED}|(?!\}}\}}).)*?)\}}\}}|\{{%((?:{_QUOTED}|(?!%\}}).)*?)%\}}|\{{#.*?#\}}", re.S)
TOKENS = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|().\[\]=]))""", re.S)
WORDS = {"true": True, "false": False, "none": None}
NESTED = 100  #: blocks that may be open at once
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := TOKENS.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.tokens[self.at][1]!r}")

    def word(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        node = self.choice()
        self.end()
        return node

    def choice(self) -> Any:
        then = self.either()
        if not self.take("if"):
            return then
        test = self.either()
        return Choice(test, then, self.choice() if self.take("else") else Const(None))

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Unary(self.negated()) if self.take("not") else self.level(0)

    def level(self, k: int) -> Any:
        if k == len(LEVELS):
            return self.postfix()
        node = self.level(k + 1)
        while op := self.take(*LEVELS[k]):
            node = Binary(op, node, self.level(k + 1))
        return node

    def postfix(self) -> Any:
        node = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                node = Get(node, Const(self.word()))
            elif op == "[":
                node = Get(node, self.choice())
                self.need("]")
            else:
                node = Filter(node, self.word())
        return node

    def atom(self) -> Any:
        kind, value = self.tokens[self.at]
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const(WORDS[value]) if value in WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    top: list = []
    open_: list[tuple[str, Any, list]] = [("", None, top)]
    at = 0
    for m in TAGS.finditer(source):
        if m.start() > at:
            open_[-1][2].append(Output(Const(plain(source[at : m.start()]))))
        at = m.end()
        if m[1] is not None:
            open_[-1][2].append(Output(Expression(m[1]).whole()))
        elif m[2] is not None:
            statement(m[2], open_)
    if at < len(source):
        open_[-1][2].append(Output(Const(plain(source[at:]))))
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't closed")
    return top


def plain(source: str) -> str:
    """Text between tags; a tag that begins in it has no end."""
    if m := re.search(r"\{[{%#]", source):
        raise TemplateError(f"{source[m.start() : m.start() + 20]!r} isn't closed")
    return source


def statement(source: str, open_: list[tuple[str, Any, list]]) -> None:
    if len(open_) > NESTED:
        raise TemplateError("nested too deeply")
    e = Expression(source)
    word, (kind, node, body) = e.word(), open_[-1]
    if word == "for":
        name = e.word()
        e.need("in")
        made: Any = For(name, e.whole(), [])
        body.append(made)
        open_.append(("for", made, made.body))
    elif word == "if":
        made = If([(e.whole(), inner := [])])
        body.append(made)
        open_.append(("if", made, inner))
    elif word in ("elif", "else") and kind == "if":
        if body is node.other:
            raise TemplateError(f"{word} after else")
        if word == "elif":
            node.branches.append((e.whole(), inner := []))
        else:
            e.end()
            inner = node.other
        open_[-1] = (kind, node, inner)
    elif word == "set":
        name = e.word()
        e.need("=")
        body.append(Assign(name, e.whole()))
    elif word == "generation":
        if any(k == "generation" for k, _, _ in open_):
            raise TemplateError("generation can't nest")
        e.end()
        made = Generation([])
        body.append(made)
        open_.append(("generation", made, made.body))
    elif word == f"end{kind}" and kind:
        e.end()
        open_.pop()
    else:
        raise TemplateError(f"unexpected {word!r}")


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """node with every part that has only constants replaced by its value."""
    if isinstance(node, Get):
        base, key = fold(node.base, filters), fold(node.key, filters)
        return Const(lookup(base.value, key.value)) if isinstance(base, Const) and isinstance(key, Const) else Get(base, key)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        base = fold(node.base, filters)
        return Const(filters[node.name](base.value)) if isinstance(base, Const) else Filter(base, node.name)
    if isinstance(node, Unary):
        value = fold(node.value, filters)
        return Const(not value.value) if isinstance(value, Const) else Unary(value)
    if isinstance(node, Choice):
        test, then, other = (fold(x, filters) for x in (node.test, node.then, node.other))
        return (then if test.value else other) if isinstance(test, Const) else Choice(test, then, other)
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(BINARY[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    return node


def fold_body(body: Iterable, filters: Mapping[str, Callable]) -> list:
    """Statements folded: constant branches chosen, neighbouring constant outputs joined."""
    out: list = []
    for s in body:
        if isinstance(s, Output):
            value = fold(s.value, filters)
            add(out, Output(Const(text(value.value)) if isinstance(value, Const) else value))
        elif isinstance(s, For):
            out.append(For(s.name, fold(s.items, filters), fold_body(s.body, filters)))
        elif isinstance(s, Assign):
            out.append(Assign(s.name, fold(s.value, filters)))
        elif isinstance(s, Generation):
            out.append(Generation(fold_body(s.body, filters)))
        else:
            kept, other = [], s.other
            for test, inner in s.branches:
                test = fold(test, filters)
                if isinstance(test, Const) and test.value:
                    other = inner
                    break
                if not isinstance(test, Const):
                    kept.append((test, fold_body(inner, filters)))
            other = fold_body(other, filters)
            for inner in [If(kept, other)] if kept else other:
                add(out, inner)
    return out


def add(out: list, s: Any) -> None:
    """Appends a statement; a constant output joins one before it, and an empty one is left out."""
    constant = isinstance(s, Output) and isinstance(s.value, Const)
    if constant and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
        out[-1] = Output(Const(out[-1].value.value + s.value.value))
    elif not constant or s.value.value:
        out.append(s)


def lookup(base: Any, key: Any) -> Any:
    if isinstance(base, Mapping):
        try:
            return base.get(key)
        except TypeError as e:
            raise TemplateError(f"no key can be {key!r}") from e
    if isinstance(base, (list, tuple)) and isinstance(key, int):
        return base[key] if -len(base) <= key < len(base) else None
    return None


def closure(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A function of the variables that gives the value of an expression."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Get):
        base, key = closure(node.base, filters), closure(node.key, filters)
        return lambda env: lookup(base(env), key(env))
    if isinstance(node, Filter):
        base, f = closure(node.base, filters), filters[node.name]
        return lambda env: f(base(env))
    if isinstance(node, Unary):
        value = closure(node.value, filters)
        return lambda env: not value(env)
    if isinstance(node, Choice):
        test, then, other = (closure(x, filters) for x in (node.test, node.then, node.other))
        return lambda env: then(env) if test(env) else other(env)
    left, right = closure(node.left, filters), closure(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    return lambda env, f=BINARY[node.op]: f(left(env), right(env))


def block(body: list, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[Any]]:
    """A generator function of the variables that yields strings, START and STOP."""
    steps = [step(s, filters) for s in body]

    def run(env: dict) -> Iterator[Any]:
        for s in steps:
            yield from s(env)

    return run


def step(s: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Iterable[Any]]:
    if isinstance(s, Output):
        value = closure(s.value, filters)
        return lambda env: (text(value(env)),)
    if isinstance(s, Assign):
        value = closure(s.value, filters)

        def assign(env: dict) -> Iterable[Any]:
            env[s.name] = value(env)
            return ()

        return assign
    if isinstance(s, Generation):
        body = block(s.body, filters)

        def generation(env: dict) -> Iterator[Any]:
            yield START
            yield from body(env)
            yield STOP

        return generation
    if isinstance(s, For):
        items, body = closure(s.items, filters), block(s.body, filters)

        def loop(env: dict) -> Iterator[Any]:
            found = items(env) or ()
            if not isinstance(found, Iterable):
                raise TemplateError(f"can't loop over {found!r}")
            for i, x in enumerate(found):
                yield from body({**env, s.name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}})

        return loop
    branches, other = [(closure(t, filters), block(b, filters)) for t, b in s.branches], block(s.other, filters)

    def branch(env: dict) -> Iterator[Any]:
        return next((body for test, body in branches if test(env)), other)(env)

    return branch


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[Any]]:
    """template source → function of the variables yielding strings and the markers START and STOP, one turn at a time."""
    given = {name: filtered(name, f) for name, f in (filters or {}).items()}
    try:
        return block(fold_body(parse(source), given), given)
    except RecursionError as e:
        raise TemplateError("nested too deeply") from e
