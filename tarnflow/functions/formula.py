"""Formulas of users, compiled to columns.

    sum     = product (("+" | "-") product)*
    product = signed (("*" | "/") signed)*
    signed  = ("+" | "-") signed | power
    power   = atom (("^" | "**") signed)?
    atom    = number | name | name "(" sum ("," sum)* ")" | "(" sum ")"

Only listed names and functions pass; anything else is a ValueError that says where.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the functions.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "exp": F.exp, "log": F.ln, "ln": F.ln, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs,
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x),
}
_TOKEN = re.compile(r"\s*(?:(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign>\*\*|[-+*/^(),]))")


class _Parser:
    def __init__(self, text: str, names: dict[str, Column], calls: dict[str, Callable[[float], Column]]):
        self.text, self.names, self.calls, self.at = text, names, calls, 0
        self.kind, self.word = "", ""
        self.advance()

    def fail(self) -> ValueError:
        return ValueError(f"not allowed in a formula: {self.word or 'its end'!r} before position {self.at} of {self.text!r}")

    def advance(self) -> None:
        rest = self.text[self.at :]
        if not rest.strip():
            self.kind = self.word = ""
            return
        found = _TOKEN.match(rest)
        if not found:
            self.word = rest.strip()[0]
            raise self.fail()
        self.at += found.end()
        self.kind, self.word = found.lastgroup, found.group(found.lastgroup)

    def took(self, *signs: str) -> str:
        """The sign at hand if it is one of these, which is then behind."""
        word = self.word if self.kind == "sign" and self.word in signs else ""
        if word:
            self.advance()
        return word

    def sum(self) -> Column:
        left = self.product()
        while sign := self.took("+", "-"):
            right = self.product()
            left = left + right if sign == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.signed()
        while sign := self.took("*", "/"):
            right = self.signed()
            left = left * right if sign == "*" else left / right
        return left

    def signed(self) -> Column:
        if sign := self.took("+", "-"):
            return -self.signed() if sign == "-" else self.signed()
        base = self.atom()
        return F.pow(base, self.signed()) if self.took("^", "**") else base

    def atom(self) -> Column:
        kind, word = self.kind, self.word
        if kind == "number":
            self.advance()
            return F.lit(float(word))
        if self.took("("):
            return self.closed(self.sum())
        if kind != "name":
            raise self.fail()
        self.advance()
        if not self.took("("):
            if word not in self.names:
                raise ValueError(f"not allowed in a formula: the name {word!r}")
            return self.names[word]
        if word in self.calls and self.kind == "number":
            value = float(self.word)
            self.advance()
            return self.closed(self.calls[word](value))
        if word not in FUNCTIONS:
            raise ValueError(f"not allowed in a formula: the function {word!r}")
        given = [self.sum()]
        while self.took(","):
            given.append(self.sum())
        return self.closed(FUNCTIONS[word](*given))

    def closed(self, inner: Column) -> Column:
        if not self.took(")"):
            raise self.fail()
        return inner


def compiled(formula: str, names: dict[str, Column], calls: dict[str, Callable[[float], Column]] | None = None) -> Column:
    """A formula as a column of named ones. ``calls`` are functions of one literal number, such as the area below a height."""
    parser = _Parser(formula, names, calls or {})
    found = parser.sum()
    if parser.kind:
        raise parser.fail()
    return found
