"""Values of mathematical expressions, plain or LaTeX: a small grammar, exact where numbers are rational, numeric elsewhere.

Nothing of a response is evaluated as code: text becomes a tree of known operations, and a tree that grows too deep or a
power that grows too large has no value.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction
from functools import lru_cache

_LEX = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d{1,3}(?![a-zA-Z\d]))?|\.\d+)|\\(?P<command>[a-zA-Z]+|.)|(?P<word>[a-zA-Z]+)|(?P<sign>\*\*|.))", re.DOTALL)
#: What commands and other signs stand for; commands mapped to nothing are layout.
_MEANS = {"cdot": "*", "times": "*", "div": "/", "left": "", "right": "", "quad": "", ",": "", "!": "", ";": "", " ": "", "**": "^", "×": "*", "÷": "/", "−": "-", "·": "*", "π": "pi"}
_FUNCTIONS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan}
_CONSTANTS = {"pi": math.pi}
_OPEN = {"(": ")", "{": "}", "[": "]"}
DEPTH, POWER, DIGITS = 60, 64, 400


class NoValue(ValueError):
    """The text is no expression of the grammar, or has no value."""


class Inexact(Exception):
    """The value is no rational number."""


def lexed(text: str) -> list[tuple[str, str]]:
    """(kind, text) of numbers, names (functions, constants, single letters) and signs."""
    out: list[tuple[str, str]] = []
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        at = m.end()
        if m["number"]:
            out.append(("number", m["number"]))
        elif m["word"]:
            rest = m["word"]
            while rest:
                known = next((k for k in sorted({*_FUNCTIONS, *_CONSTANTS}, key=len, reverse=True) if rest.startswith(k)), rest[0])
                out.append(("name", known))
                rest = rest[len(known) :]
        else:
            sign = m["command"] or m["sign"]
            sign = "\\" + sign if m["command"] and sign in _OPEN else _MEANS.get(sign, sign)
            if sign in ("frac", "dfrac", "tfrac"):
                out.append(("frac", sign))
            elif sign in _FUNCTIONS or sign in _CONSTANTS:
                out.append(("name", sign))
            elif sign:
                out.append(("sign", sign))
    return out


class Parser:
    """Recursive descent over tokens to trees: (operation, operands ..)."""

    def __init__(self, tokens: list[tuple[str, str]], letters: bool):
        self.tokens, self.at, self.letters, self.depth = tokens, 0, letters, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def eat(self, *signs: str) -> str:
        kind, text = self.peek()
        if kind == "sign" and text in signs:
            self.at += 1
            return text
        return ""

    def whole(self) -> tuple:
        tree = self.sum()
        if self.at < len(self.tokens):
            raise NoValue
        return tree

    def sum(self) -> tuple:
        tree = self.product()
        while sign := self.eat("+", "-"):
            tree = (sign, tree, self.product())
        return tree

    def product(self) -> tuple:
        tree = self.signed()
        while True:
            kind, text = self.peek()
            if sign := self.eat("*", "/"):
                tree = (sign, tree, self.signed())
            elif kind in ("name", "frac") or (kind == "sign" and text in "({") and text:
                tree = ("*", tree, self.power())
            else:
                return tree

    def signed(self) -> tuple:
        if self.eat("-"):
            return ("neg", self.signed())
        self.eat("+")
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        return ("^", base, self.signed()) if self.eat("^") else base

    def atom(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise NoValue
        try:
            kind, text = self.peek()
            self.at += 1
            if kind == "number":
                return ("number", Fraction(text))
            if kind == "frac":
                return ("/", self.argument(), self.argument())
            if kind == "name" and text in _FUNCTIONS:
                if self.eat("["):
                    root = self.sum()
                    if not self.eat("]"):
                        raise NoValue
                    return ("^", self.argument(), ("/", ("number", Fraction(1)), root))
                return ("call", text, self.argument())
            if kind == "name" and (text in _CONSTANTS or self.letters):
                return ("name", text)
            if kind == "sign" and text in _OPEN:
                inner = self.sum()
                if not self.eat(_OPEN[text]):
                    raise NoValue
                return inner
            raise NoValue
        finally:
            self.depth -= 1

    def argument(self) -> tuple:
        """A bracketed group, or one digit or name, as LaTeX takes its arguments."""
        kind, text = self.peek()
        if kind == "number" and len(text) > 1 and "." not in text:
            self.tokens[self.at : self.at + 1] = [("number", c) for c in text]
        return self.atom()


def _power(base, exponent, exact: bool):
    if exact:
        if exponent.denominator != 1:
            raise Inexact
        if abs(exponent) > POWER or max(abs(base.numerator), base.denominator).bit_length() * abs(int(exponent)) > DIGITS * 4:
            raise NoValue
        return base ** int(exponent)
    return base**exponent


def value(tree: tuple, names: dict, exact: bool):
    """Of a tree: a Fraction where ``exact`` (or Inexact), else a complex number."""
    op = tree[0]
    if op == "number":
        return tree[1] if exact else complex(tree[1])
    if op == "name":
        if tree[1] in _CONSTANTS:
            if exact:
                raise Inexact
            return complex(_CONSTANTS[tree[1]])
        return names[tree[1]]
    if op == "neg":
        return -value(tree[1], names, exact)
    if op == "call":
        if exact:
            inner = value(tree[2], names, exact) if tree[1] == "sqrt" else None
            if inner is None or inner < 0:
                raise Inexact
            roots = math.isqrt(inner.numerator), math.isqrt(inner.denominator)
            if (roots[0] ** 2, roots[1] ** 2) != (inner.numerator, inner.denominator):
                raise Inexact
            return Fraction(*roots)
        return _FUNCTIONS[tree[1]](value(tree[2], names, exact))
    a, b = value(tree[1], names, exact), value(tree[2], names, exact)
    if op == "^":
        return _power(a, b, exact)
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b


def letters_of(tree: tuple) -> set[str]:
    if tree[0] == "name":
        return {tree[1]} - _CONSTANTS.keys()
    return set().union(*[letters_of(t) for t in tree[1:] if isinstance(t, tuple)])


@lru_cache(maxsize=4096)
def parsed(text: str, letters: bool = True) -> tuple | None:
    """The tree of an expression, or null; ``letters``: single letters are unknowns."""
    if len(text) > 2000:
        return None
    try:
        tokens = lexed(text)
        return Parser(tokens, letters).whole() if tokens else None
    except (NoValue, RecursionError, ValueError, OverflowError):
        return None


def rational(text: str) -> Fraction | None:
    """The exact value of arithmetic over numbers; null for anything else."""
    tree = parsed(text, False)
    try:
        return None if tree is None else value(tree, {}, True)
    except (NoValue, Inexact, ZeroDivisionError, OverflowError, ValueError):
        return None


def real(text: str) -> float | None:
    """The value of an expression without unknowns, as a real number."""
    tree = parsed(text, False)
    try:
        if tree is None:
            return None
        try:
            return float(value(tree, {}, True))
        except Inexact:
            found = value(tree, {}, False)
            return found.real if abs(found.imag) < 1e-12 * (1 + abs(found)) else None
    except (NoValue, ZeroDivisionError, OverflowError, ValueError):
        return None


def _points(names: list[str]):
    """Fixed places to compare at: one for numbers, five for unknowns."""
    for k in range(5 if names else 1):
        yield {n: Fraction(3 + 7 * k + 11 * i, 5 + 3 * k + 2 * i) for i, n in enumerate(names)}


def same(a: str, b: str, unknowns: int = 2) -> bool:
    """Whether two expressions are equal in their unknowns, at most so many of them: exactly where their values at fixed rational
    places are rational, to nine digits elsewhere."""
    x, y = parsed(a), parsed(b)
    if x is None or y is None:
        return False
    names = sorted(letters_of(x) | letters_of(y))
    if len(names) > unknowns:
        return False
    compared = 0
    for place in _points(names):
        try:
            try:
                if value(x, place, True) != value(y, place, True):
                    return False
            except Inexact:
                rough = {n: complex(v) for n, v in place.items()}
                p, q = value(x, rough, False), value(y, rough, False)
                if not abs(p - q) <= 1e-9 * (abs(p) + abs(q) + 1e-30):
                    return False
            compared += 1
        except ZeroDivisionError:
            continue
        except (NoValue, OverflowError, ValueError):
            return False
    return compared > 0
