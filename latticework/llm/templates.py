"""A compiler of a small, sandboxed template language into Python closures.

`compiled(source)` parses a template into a syntax tree, folds what is constant, and makes a generator of pieces (text, generated)
from the rest; `generated` tells the parts under a `generation` mark, which are what a language model learns to say.

The language, a part of what chat templates commonly use:

* `{{ expression }}` puts out a string or a number; `{# ... #}` is a comment; a `-` inside a mark eats the white space beside it.
* `{% for x in e %} ... {% else %} ... {% endfor %}`, with `loop.index`, `index0`, `first`, `last`, `previtem` and `nextitem`;
  `{% if %} ... {% elif %} ... {% else %} ... {% endif %}`, `{% set x = e %}`, `{% generation %} ... {% endgeneration %}`.
* Expressions: strings, integers, `true`, `false`, `none`, lists, names, `a.b`, `a[b]`, `+ - * // % ~`, comparisons, `in`, `not in`,
  `and`, `or`, `not`, `a if b else c`, filters `a | f` or `a | f(x)`, and tests `a is defined`, `is none`, `is string`, and `not`.

The sandbox: names are those that the caller gives; `a.b` looks a key up in a dict and never an attribute; there are no calls but
of filters, which the caller lists; integers stay within 64 bits and only numbers are multiplied, so nothing grows but by loops
over what the caller gives; nesting is bounded. What is undefined cannot be put out: that is an error, as is all else here that
does not make sense (`TemplateError`).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

#: Blocks and brackets that may lie in each other.
DEPTH = 50
Piece = tuple[str, bool]
Scope = dict[str, Any]
Value = Callable[[Scope], Any]
Body = Callable[[Scope, bool], Iterator[Piece]]


class TemplateError(ValueError):
    pass


class Undefined:
    """What a name or key that is not there gives; it is false, and cannot be put out."""

    def __bool__(self) -> bool:
        return False


UNDEFINED = Undefined()


class Stream:
    """A sequence that is read once, front to back; its first element may be looked at before."""

    def __init__(self, items: Iterable):
        self._items, self._head, self._begun = iter(items), [], False

    def first(self) -> Any:
        if not self._head and not self._begun:
            self._head = list(itertools.islice(self._items, 1))
        return self._head[0] if self._head else UNDEFINED

    def __iter__(self) -> Iterator:
        self.first()
        if self._begun:
            raise TemplateError("a stream can be read only once")
        self._begun = True
        return itertools.chain(self._head, self._items)


# --- the tree -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on the values of other expressions."""

    what: str
    args: tuple
    function: Callable | None = None


@dataclass(frozen=True)
class Choice:
    """`and`, `or` and `if` expressions: what is not needed is not evaluated."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    body: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- operations -----------------------------------------------------------------------------------------------------


def _whole(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int):
        raise TemplateError(f"not a number: {type(x).__name__}")
    if not -(1 << 63) <= x < 1 << 63:
        raise TemplateError("a number is out of bounds")
    return x


def shown(x: Any) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, int) and not isinstance(x, bool):
        return str(_whole(x))
    raise TemplateError(f"cannot be put out: {type(x).__name__}")


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, str) and isinstance(b, str) else _whole(_whole(a) + _whole(b))


def _over(f: Callable[[int, int], int]) -> Callable:
    def divided(a: Any, b: Any) -> int:
        if not _whole(b):
            raise TemplateError("division by zero")
        return _whole(f(_whole(a), b))

    return divided


def _ordered(f: Callable) -> Callable:
    def compared(a: Any, b: Any) -> bool:
        if isinstance(a, str) != isinstance(b, str):
            raise TemplateError("values of two kinds have no order")
        return f(a, b) if isinstance(a, str) else f(_whole(a), _whole(b))

    return compared


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str) and isinstance(a, str) or isinstance(b, (list, tuple, dict)):
        return a in b
    raise TemplateError("`in` needs a string, a list or a dict")


def item(a: Any, key: Any) -> Any:
    """The value of a key of a dict, or of a position of a list or string; never an attribute."""
    if isinstance(a, dict):
        return a.get(key, UNDEFINED) if isinstance(key, (str, int)) else UNDEFINED
    if isinstance(a, Stream):
        if key == 0:
            return a.first()
        raise TemplateError("of a stream only the first element can be looked at")
    if isinstance(a, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return a[key] if -len(a) <= key < len(a) else UNDEFINED
    if isinstance(a, Undefined):
        raise TemplateError("an undefined value has no parts")
    return UNDEFINED


OPERATIONS: dict[str, Callable] = {
    "+": _plus,
    "-": lambda a, b: _whole(_whole(a) - _whole(b)),
    "*": lambda a, b: _whole(_whole(a) * _whole(b)),
    "//": _over(lambda a, b: a // b),
    "%": _over(lambda a, b: a % b),
    "~": lambda a, b: shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _within,
    "not in": lambda a, b: not _within(a, b),
    "not": lambda a: not a,
    "item": item,
    "list": lambda *a: list(a),
    "defined": lambda a: not isinstance(a, Undefined),
    "none": lambda a: a is None,
    "string": lambda a: isinstance(a, str),
}


def _long(x: Any) -> int:
    if isinstance(x, (str, list, tuple, dict)):
        return len(x)
    raise TemplateError("only strings, lists and dicts have a length")


def _text(f: Callable[[str], str]) -> Callable[[Any], str]:
    return lambda x: f(shown(x))


FILTERS: dict[str, Callable] = {
    "trim": _text(str.strip),
    "upper": _text(str.upper),
    "lower": _text(str.lower),
    "string": shown,
    "length": _long,
    "default": lambda x, other="": other if isinstance(x, Undefined) else x,
    "first": lambda x: item(x, 0),
    "last": lambda x: item(x, -1),
    "join": lambda x, by="": by.join(map(shown, x)),
}


# --- parsing --------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"\{[%{#]-?")
_TOKEN = re.compile(r"""\s*(?:(?P<end>-?[%}]\})|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>//|[=!<>]=|[-+*%~<>|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEPT = {"and", "or", "not", "in", "is", "if", "else", *_WORDS}


def _unquoted(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)


class Parser:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.source, self.filters, self.at, self.depth = source, filters, 0, 0
        self.tokens: list[tuple[str, str]] = []
        self.eat = False  # white space at the head of the next text
        self.met = ""

    # texts and blocks

    def body(self, *ends: str) -> tuple:
        """Statements up to one of the blocks that may end them, whose word is then in `met`."""
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("blocks lie too deep")
        out: list = []
        while True:
            m = _MARK.search(self.source, self.at)
            text = self.source[self.at : m.start() if m else len(self.source)]
            text = text.lstrip() if self.eat else text
            text = text.rstrip() if m and m[0].endswith("-") else text
            self.eat = False
            if text:
                out.append(Text(text))
            if not m:
                if ends:
                    raise TemplateError(f"{ends[-1]} is missing")
                break
            self.at = m.end()
            if m[0].startswith("{#"):
                end = self.source.find("#}", self.at)
                if end < 0:
                    raise TemplateError("a comment does not end")
                self.eat, self.at = self.source[self.at : end].endswith("-"), end + 2
                continue
            self.scan("}}" if m[0].startswith("{{") else "%}")
            if m[0].startswith("{{"):
                out.append(Out(self.expression()))
                self.done()
                continue
            word = self.take("name")
            if word in ends:
                self.met = word
                break
            out.append(self.statement(word))
        self.depth -= 1
        return tuple(out)

    def statement(self, word: str) -> Any:
        if word == "for":
            name = self.variable()
            self.need("in")
            over = self.expression()
            self.done()
            body, otherwise = self.body("else", "endfor"), ()
            if self.met == "else":
                self.done()
                otherwise = self.body("endfor")
            self.done()
            return Loop(name, over, body, otherwise)
        if word == "if":
            return self.branch()
        if word == "set":
            name = self.variable()
            self.need("=")
            value = self.expression()
            self.done()
            return Assign(name, value)
        if word == "generation":
            self.done()
            body = self.body("endgeneration")
            self.done()
            return Generation(body)
        raise TemplateError(f"unknown or misplaced block: {word}")

    def branch(self) -> Branch:
        test = self.expression()
        self.done()
        body = self.body("elif", "else", "endif")
        if self.met == "elif":
            self.depth += 1
            if self.depth > DEPTH:
                raise TemplateError("blocks lie too deep")
            otherwise = (self.branch(),)
            self.depth -= 1
            return Branch(test, body, otherwise)
        otherwise: tuple = ()
        if self.met == "else":
            self.done()
            otherwise = self.body("endif")
        self.done()
        return Branch(test, body, otherwise)

    # tokens of one mark

    def scan(self, end: str) -> None:
        self.tokens = []
        while True:
            m = _TOKEN.match(self.source, self.at)
            if not m:
                raise TemplateError(f"cannot be read: {self.source[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m["end"]:
                if not m["end"].endswith(end):
                    raise TemplateError(f"{end} is missing")
                self.eat = m["end"].startswith("-")
                return
            self.tokens.append((m.lastgroup, m[m.lastgroup]))

    def peek(self) -> str:
        """The next sign or word; a string is none."""
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] in ("name", "sign") else ""

    def take(self, kind: str) -> str:
        if not self.tokens or self.tokens[0][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        return self.tokens.pop(0)[1]

    def variable(self) -> str:
        name = self.take("name")
        if name in _KEPT or name == "loop":
            raise TemplateError(f"no name for a variable: {name}")
        return name

    def has(self, *words: str) -> bool:
        """Takes these signs or words, if they are next."""
        if [t[1] for t in self.tokens[: len(words)] if t[0] in ("name", "sign")] != list(words):
            return False
        del self.tokens[: len(words)]
        return True

    def need(self, word: str) -> None:
        if not self.has(word):
            raise TemplateError(f"{word} is missing")

    def done(self) -> None:
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens[0][1]}")

    # expressions, from the loosest to the tightest

    def expression(self) -> Any:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("expressions lie too deep")
        out = self.either()
        if self.has("if"):
            test = self.either()
            out = Choice("if", (test, out, self.expression() if self.has("else") else Const(UNDEFINED)))
        self.depth -= 1
        return out

    def either(self) -> Any:
        out = self.both()
        while self.has("or"):
            out = Choice("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.has("and"):
            out = Choice("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        n = 0
        while self.has("not"):
            n += 1
        out = self.compared()
        for _ in range(min(n, 2 - n % 2)):
            out = Apply("not", (out,))
        return out

    def compared(self) -> Any:
        out = self.sum()
        while True:
            if self.has("not", "in"):
                out = Apply("not in", (out, self.sum()))
            elif self.has("is"):
                no = self.has("not")
                test = self.take("name")
                if test not in ("defined", "none", "string"):
                    raise TemplateError(f"unknown test: {test}")
                out = Apply(test, (out,))
                out = Apply("not", (out,)) if no else out
            elif self.peek() in ("==", "!=", "<", "<=", ">", ">=", "in"):
                out = Apply(self.tokens.pop(0)[1], (out, self.sum()))
            else:
                return out

    def sum(self) -> Any:
        out = self.product()
        while self.peek() in ("+", "-", "~"):
            out = Apply(self.tokens.pop(0)[1], (out, self.product()))
        return out

    def product(self) -> Any:
        out = self.filtered()
        while self.peek() in ("*", "//", "%"):
            out = Apply(self.tokens.pop(0)[1], (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.primary()
        while True:
            if self.has("."):
                out = Apply("item", (out, Const(self.take("name"))))
            elif self.has("["):
                out = Apply("item", (out, self.expression()))
                self.need("]")
            elif self.has("|"):
                name = self.take("name")
                if name not in self.filters:
                    raise TemplateError(f"unknown filter: {name}")
                out = Apply(name, (out, *(self.several(")") if self.has("(") else ())), self.filters[name])
            else:
                return out

    def several(self, end: str) -> list:
        out: list = []
        while not self.has(end):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def primary(self) -> Any:
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, value = self.tokens.pop(0)
        if kind == "string":
            return Const(_unquoted(value))
        if kind == "number":
            return Const(_whole(int(value)))
        if kind == "name" and value in _WORDS:
            return Const(_WORDS[value])
        if kind == "name" and value not in _KEPT:
            return Name(value)
        if value == "-":
            return Apply("-", (Const(0), self.primary()))
        if value == "(":
            out = self.expression()
            self.need(")")
            return out
        if value == "[":
            return Apply("list", tuple(self.several("]")))
        raise TemplateError(f"misplaced: {value}")


def parsed(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    return Parser(source, FILTERS | (filters or {})).body()


# --- folding --------------------------------------------------------------------------------------------------------


def folded(e: Any) -> Any:
    """The same expression with what is constant computed; what would fail stays, and fails when it is rendered."""
    if isinstance(e, Choice):
        args = tuple(map(folded, e.args))
        first = args[0]
        if not isinstance(first, Const):
            return Choice(e.what, args)
        if e.what == "if":
            return args[1] if first.value else args[2]
        return args[1] if bool(first.value) == (e.what == "and") else first
    if not isinstance(e, Apply):
        return e
    args = tuple(map(folded, e.args))
    if all(isinstance(a, Const) for a in args):
        try:
            return Const((e.function or OPERATIONS[e.what])(*(a.value for a in args)))
        except (TemplateError, TypeError):
            pass
    return Apply(e.what, args, e.function)


def folded_body(body: tuple) -> tuple:
    """The same statements: constants put out are texts, adjoining texts one, and branches on constants and empty loops gone."""
    out: list = []
    for s in body:
        if isinstance(s, Out):
            value = folded(s.value)
            fixed = isinstance(value, Const) and (isinstance(value.value, str) or (isinstance(value.value, int) and not isinstance(value.value, bool)))
            new: tuple = (Text(str(value.value)),) if fixed else (Out(value),)
        elif isinstance(s, Branch):
            test = folded(s.test)
            if isinstance(test, Const):
                new = folded_body(s.body if test.value else s.otherwise)
            else:
                new = (Branch(test, folded_body(s.body), folded_body(s.otherwise)),)
        elif isinstance(s, Loop):
            over = folded(s.over)
            new = folded_body(s.otherwise) if over == Const([]) else (Loop(s.name, over, folded_body(s.body), folded_body(s.otherwise)),)
        elif isinstance(s, Generation):
            new = (Generation(folded_body(s.body)),)
        elif isinstance(s, Assign):
            new = (Assign(s.name, folded(s.value)),)
        else:
            new = (s,)
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif x != Text(""):
                out.append(x)
    return tuple(out)


# --- closures -------------------------------------------------------------------------------------------------------


def value_of(e: Any) -> Value:
    """A closure that gives the value of an expression."""
    if isinstance(e, Const):
        value = e.value
        return lambda scope: value
    if isinstance(e, Name):
        name = e.name
        return lambda scope: scope.get(name, UNDEFINED)
    args = [value_of(a) for a in e.args]
    if isinstance(e, Choice):
        if e.what == "if":
            test, yes, no = args
            return lambda scope: yes(scope) if test(scope) else no(scope)
        a, b = args
        return (lambda scope: a(scope) and b(scope)) if e.what == "and" else (lambda scope: a(scope) or b(scope))
    f = e.function or OPERATIONS[e.what]
    if len(args) == 1:
        (a,) = args
        return lambda scope: f(a(scope))
    if len(args) == 2:
        a, b = args
        return lambda scope: f(a(scope), b(scope))
    return lambda scope: f(*(a(scope) for a in args))


#: Put out after each round of an outermost loop: what has been put out so far may be cut off here.
CUT: Piece = ("", False)


def statement_of(s: Any, outermost: bool) -> Body:
    if isinstance(s, Text):
        text = s.text

        def put(scope: Scope, generated: bool) -> Iterator[Piece]:
            yield text, generated

    elif isinstance(s, Out):
        value = value_of(s.value)

        def put(scope: Scope, generated: bool) -> Iterator[Piece]:
            yield shown(value(scope)), generated

    elif isinstance(s, Assign):
        value, name = value_of(s.value), s.name

        def put(scope: Scope, generated: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

    elif isinstance(s, Branch):
        test, yes, no = value_of(s.test), body_of(s.body), body_of(s.otherwise)

        def put(scope: Scope, generated: bool) -> Iterator[Piece]:
            return (yes if test(scope) else no)(scope, generated)

    elif isinstance(s, Generation):
        body = body_of(s.body)

        def put(scope: Scope, generated: bool) -> Iterator[Piece]:
            return body(scope, True)

    else:
        put = _loop(s, outermost)
    return put


def _loop(s: Loop, outermost: bool) -> Body:
    name, over, body, otherwise = s.name, value_of(s.over), body_of(s.body), body_of(s.otherwise)

    def put(scope: Scope, generated: bool) -> Iterator[Piece]:
        items = over(scope)
        if not isinstance(items, (list, tuple, Stream)):
            raise TemplateError("a loop needs a list")
        rest = iter(items)
        last = object()
        before, now = UNDEFINED, next(rest, last)
        if now is last:
            yield from otherwise(scope, generated)
        index = 0
        while now is not last:
            after = next(rest, last)
            inner = dict(scope)  # what a round sets ends with it
            inner[name] = now
            inner["loop"] = {
                "index": index + 1, "index0": index, "first": not index, "last": after is last,
                "previtem": before, "nextitem": UNDEFINED if after is last else after,
            }
            yield from body(inner, generated)
            if outermost:
                yield CUT
            before, now, index = now, after, index + 1

    return put


def body_of(body: tuple, outermost: bool = False) -> Body:
    parts = [statement_of(s, outermost) for s in body]
    if len(parts) == 1:
        return parts[0]

    def put(scope: Scope, generated: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope, generated)

    return put


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of named values that gives the pieces of the rendered template, with `CUT` after rounds of outermost loops."""
    put = body_of(folded_body(parsed(source, filters)), outermost=True)
    return lambda **values: put(dict(values), False)
