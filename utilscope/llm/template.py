"""A small sandboxed template language: syntax tree, constant folding, Python closures.

    {{ expression }}                 output
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in e %} {% endfor %} with loop.index, index0, first, last, length
    {% set name = e %}
    {% generation %} {% endgeneration %}   marks what a model would write
    {# comment #}                    a '-' inside a delimiter trims the white space beside it

Expressions: literals, names, a.b and a[b] on mappings and lists, `| filter`, + - * // % ~ (text
concatenation), comparisons, `in`, `not`, `and`, `or`, `x if c else y`. There are no calls and no
access to Python attributes, so a template reads only the values it is given.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template is malformed, or asks for something that its values don't have."""


# --- syntax tree -------------------------------------------------------------------


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
    symbol: str
    of: Any


@dataclass(frozen=True)
class Binary:
    symbol: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    condition: Any
    then: Any
    otherwise: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser ------------------------------------------------------------------------

_DELIMITED = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_LEXEME = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<symbol>==|!=|<=|>=|//|[-+*%~<>|.()\[\]=,]))",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_LITERALS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_WORDS = {"and", "or", "not", "in", "if", "else"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.source, self.lexemes, at = source, [], 0
        end = len(source.rstrip())
        while at < end:
            found = _LEXEME.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.lexemes.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        kind, value = self.lexemes[self.at] if self.at < len(self.lexemes) else ("end", "")
        return kind in ("symbol", "name") and value in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def name(self) -> str:
        kind, value = self.lexemes[self.at] if self.at < len(self.lexemes) else ("end", "")
        if kind != "name" or value in _WORDS:
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        tree = self.choice()
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r} in {self.source!r}")
        return tree

    def choice(self) -> Any:
        tree = self.either()
        if self.take("if"):
            condition = self.either()
            otherwise = self.choice() if self.take("else") else Const("")
            tree = Choice(condition, tree, otherwise)
        return tree

    def either(self) -> Any:
        tree = self.both()
        while self.take("or"):
            tree = Binary("or", tree, self.both())
        return tree

    def both(self) -> Any:
        tree = self.negation()
        while self.take("and"):
            tree = Binary("and", tree, self.negation())
        return tree

    def negation(self) -> Any:
        return Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        tree = self.sum()
        for symbol in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self.take(symbol):
                return Binary(symbol, tree, self.sum())
        if self.take("not"):
            self.need("in")
            return Unary("not", Binary("in", tree, self.sum()))
        return tree

    def sum(self) -> Any:
        tree = self.product()
        while self.peek("+", "-", "~"):
            symbol = self.lexemes[self.at][1]
            self.at += 1
            tree = Binary(symbol, tree, self.product())
        return tree

    def product(self) -> Any:
        tree = self.filtered()
        while self.peek("*", "//", "%"):
            symbol = self.lexemes[self.at][1]
            self.at += 1
            tree = Binary(symbol, tree, self.filtered())
        return tree

    def filtered(self) -> Any:
        tree = Unary("-", self.filtered()) if self.take("-") else self.atom()
        while True:
            if self.take("|"):
                tree = Filter(self.name(), tree)
            elif self.take("."):
                tree = Item(tree, Const(self.name()))
            elif self.take("["):
                tree = Item(tree, self.choice())
                self.need("]")
            else:
                return tree

    def atom(self) -> Any:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        kind, value = self.lexemes[self.at] if self.at < len(self.lexemes) else ("end", "")
        if kind == "number":
            self.at += 1
            return Const(float(value) if "." in value else int(value))
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "name" and value in _LITERALS:
            self.at += 1
            return Const(_LITERALS[value])
        return Name(self.name())


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "output" | "statement", content) in order, with the trimming done."""
    pieces, at, trim = [], 0, False
    for found in _DELIMITED.finditer(source):
        text = source[at:found.start()]
        text = text.lstrip() if trim else text
        before, content, after = next(
            (found[i], found[i + 1], found[i + 2]) for i in (1, 4, 7) if found[i + 1] is not None
        )
        pieces.append(("text", text.rstrip() if before else text))
        kind = {"{{": "output", "{%": "statement", "{#": "comment"}[found[0][:2]]
        pieces.append((kind, content.strip()))
        at, trim = found.end(), bool(after)
    rest = source[at:]
    if "{{" in rest or "{%" in rest:
        raise TemplateError("a delimiter isn't closed")
    pieces.append(("text", rest.lstrip() if trim else rest))
    return [p for p in pieces if p[1] and p[0] != "comment"]


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    pieces = _pieces(source)
    at = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        statements = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                statements.append(Output(Const(content)))
                continue
            if kind == "output":
                statements.append(Output(_Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(statements), content
            statements.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(statements), ""

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            branches, otherwise, condition = [], (), _Expression(rest).whole()
            while True:
                inner, end = body("elif", "else", "endif")
                branches.append((condition, inner))
                if end.startswith("elif"):
                    condition = _Expression(end[4:]).whole()
                    continue
                if end == "else":
                    otherwise, _ = body("endif")
                return If(tuple(branches), otherwise)
        if word == "for":
            parser = _Expression(rest)
            name = parser.name()
            parser.need("in")
            of = parser.whole()
            return For(name, of, body("endfor")[0])
        if word == "set":
            parser = _Expression(rest)
            name = parser.name()
            parser.need("=")
            return Set(name, parser.whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# --- values and folding ------------------------------------------------------------


def _item(of: Any, key: Any) -> Any:
    try:
        if isinstance(of, Mapping) or isinstance(of, (list, tuple, str)) and isinstance(key, int):
            return of[key]
    except LookupError:
        pass
    raise TemplateError(f"no item {key!r}")


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": operator.add, "-": operator.sub, "//": operator.floordiv, "==": operator.eq,
    "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "~": lambda a, b: _shown(a) + _shown(b), "in": lambda a, b: a in b,
    "*": lambda a, b: _numeric(a) * _numeric(b), "%": lambda a, b: _numeric(a) % _numeric(b),
}


def _numeric(value: Any) -> Any:
    """Only numbers are multiplied or divided: no text grows by repetition."""
    if isinstance(value, str):
        raise TemplateError("a number is needed")
    return value


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _shown(v).strip(),
    "upper": lambda v: _shown(v).upper(),
    "lower": lambda v: _shown(v).lower(),
    "string": _shown,
    "length": len,
}


def fold(tree: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with constant parts computed, dead branches gone and neighbouring texts joined."""
    if isinstance(tree, tuple):
        statements: list = []
        for statement in tree:
            for part in _folded_statement(statement, filters):
                last = statements[-1] if statements else None
                if isinstance(part, Output) and isinstance(part.of, Const):
                    if isinstance(last, Output) and isinstance(last.of, Const):
                        statements[-1] = Output(Const(_shown(last.of.value) + _shown(part.of.value)))
                        continue
                statements.append(part)
        return tuple(statements)
    if isinstance(tree, Item):
        of, key = fold(tree.of, filters), fold(tree.key, filters)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(tree, Unary):
        of = fold(tree.of, filters)
        if isinstance(of, Const):
            return Const(not of.value if tree.symbol == "not" else -_numeric(of.value))
        return Unary(tree.symbol, of)
    if isinstance(tree, Binary):
        left, right = fold(tree.left, filters), fold(tree.right, filters)
        if tree.symbol in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (tree.symbol == "and") else left
        if isinstance(left, Const) and isinstance(right, Const) and tree.symbol in _BINARY:
            return Const(_BINARY[tree.symbol](left.value, right.value))
        return Binary(tree.symbol, left, right)
    if isinstance(tree, Choice):
        condition = fold(tree.condition, filters)
        if isinstance(condition, Const):
            return fold(tree.then if condition.value else tree.otherwise, filters)
        return Choice(condition, fold(tree.then, filters), fold(tree.otherwise, filters))
    if isinstance(tree, Filter):
        if tree.name not in filters:
            raise TemplateError(f"unknown filter {tree.name!r}")
        of = fold(tree.of, filters)
        return Const(filters[tree.name](of.value)) if isinstance(of, Const) else Filter(tree.name, of)
    return tree


def _folded_statement(statement: Any, filters: Mapping[str, Callable]) -> tuple:
    """What a statement folds to: none, itself, or the statements of the branch that is taken."""
    if isinstance(statement, Output):
        return (Output(fold(statement.of, filters)),)
    if isinstance(statement, Set):
        return (Set(statement.name, fold(statement.of, filters)),)
    if isinstance(statement, For):
        of = fold(statement.of, filters)
        return () if isinstance(of, Const) and not of.value else (For(statement.name, of, fold(statement.body, filters)),)
    if isinstance(statement, Generation):
        return (Generation(fold(statement.body, filters)),)
    open_branches = []
    for condition, inner in statement.branches:
        condition = fold(condition, filters)
        if isinstance(condition, Const):
            if not condition.value:
                continue
            taken = fold(inner, filters)
            return (If(tuple(open_branches), taken),) if open_branches else taken
        open_branches.append((condition, fold(inner, filters)))
    otherwise = fold(statement.otherwise, filters)
    return (If(tuple(open_branches), otherwise),) if open_branches else otherwise


# --- closures ----------------------------------------------------------------------


@dataclass
class Page:
    """What is being rendered: texts, code points so far, and the spans under a generation marker."""

    texts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)


def _value(tree: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(tree, Const):
        constant = tree.value
        return lambda env: constant
    if isinstance(tree, Name):
        name = tree.name

        def look_up(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"{name!r} is not given")
            return env[name]

        return look_up
    if isinstance(tree, Item):
        of, key = _value(tree.of, filters), _value(tree.key, filters)
        return lambda env: _item(of(env), key(env))
    if isinstance(tree, Unary):
        of = _value(tree.of, filters)
        return (lambda env: not of(env)) if tree.symbol == "not" else (lambda env: -_numeric(of(env)))
    if isinstance(tree, Binary):
        left, right = _value(tree.left, filters), _value(tree.right, filters)
        if tree.symbol == "and":
            return lambda env: left(env) and right(env)
        if tree.symbol == "or":
            return lambda env: left(env) or right(env)
        apply = _BINARY[tree.symbol]
        return lambda env: apply(left(env), right(env))
    if isinstance(tree, Choice):
        condition, then, other = (_value(t, filters) for t in (tree.condition, tree.then, tree.otherwise))
        return lambda env: then(env) if condition(env) else other(env)
    of, apply = _value(tree.of, filters), filters[tree.name]
    return lambda env: apply(of(env))


def _body(statements: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Page], None]:
    steps = [_step(statement, filters) for statement in statements]

    def run(env: dict, page: Page) -> None:
        for step in steps:
            step(env, page)

    return run


def _step(statement: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Page], None]:
    if isinstance(statement, Output):
        value = _value(statement.of, filters)

        def output(env: dict, page: Page) -> None:
            text = _shown(value(env))
            page.texts.append(text)
            page.length += len(text)

        return output
    if isinstance(statement, Set):
        name, value = statement.name, _value(statement.of, filters)
        return lambda env, page: env.__setitem__(name, value(env))
    if isinstance(statement, If):
        branches = [(_value(c, filters), _body(b, filters)) for c, b in statement.branches]
        otherwise = _body(statement.otherwise, filters)

        def branch(env: dict, page: Page) -> None:
            next((b for c, b in branches if c(env)), otherwise)(env, page)

        return branch
    if isinstance(statement, For):
        name, of, body = statement.name, _value(statement.of, filters), _body(statement.body, filters)

        def loop(env: dict, page: Page) -> None:
            items = list(of(env))
            for i, item in enumerate(items):
                place = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                body({**env, name: item, "loop": place}, page)

        return loop
    body = _body(statement.body, filters)

    def generation(env: dict, page: Page) -> None:
        start = page.length
        body(env, page)
        page.spans.append((start, page.length))

    return generation


class Template:
    """A compiled template; `filters` are added to the built-in ones."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source), known)
        self._run = _body(self.tree, known)

    def render(self, values: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        """The text and the code point spans under generation markers."""
        page = Page()
        self._run(dict(values), page)
        return "".join(page.texts), page.spans
