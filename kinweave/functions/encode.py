"""Column expressions that turn raw values into codes, and codes into values."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_list(x: Column, values: Sequence) -> Column:
    """The value's place in the list; the length of the list for nulls and values outside of it."""
    out = F.lit(len(values))
    for i in range(len(values) - 1, -1, -1):
        out = F.when(x == F.lit(values[i]), F.lit(i)).otherwise(out)
    return out.cast("int")


def passed(x: Column, cuts: Sequence[float], inclusive: bool = True) -> Column:
    """How many of the cuts x has reached (x >= cut) or, if not inclusive, has exceeded (x > cut)."""
    steps = [(x >= F.lit(float(c)) if inclusive else x > F.lit(float(c))).cast("int") for c in cuts]
    return reduce(lambda a, b: a + b, steps, F.lit(0)).cast("int")


def divided(x: Column, width: float, lo: int, hi: int, shift: float = 0.0) -> Column:
    """floor((x + shift) / width), forced into [lo, hi]."""
    q = F.floor((x + F.lit(shift)) / F.lit(width)) if shift else F.floor(x / F.lit(width))
    return F.least(F.greatest(q, F.lit(lo)), F.lit(hi)).cast("int")


def cases(arms: Sequence[tuple[Column, int]], default: int) -> Column:
    """The code of the last arm that holds, as a chain of assignments would leave it."""
    out = F.lit(default)
    for condition, code in arms:
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out.cast("int")


def looked_up(x: Column, codes: Sequence[int]) -> Column:
    """codes[x], with x forced into the table."""
    at = F.least(F.greatest(x, F.lit(0)), F.lit(len(codes) - 1)) + 1
    return F.element_at(F.array(*(F.lit(int(c)) for c in codes)), at.cast("int"))


def capped_from_one(x: Column, most: int) -> Column:
    """x forced into 1..most, counted from 0."""
    return (F.least(F.greatest(x, F.lit(1)), F.lit(most)) - 1).cast("int")


def size_bin(size: Column, edges: Sequence[int]) -> Column:
    """The last edge that the size reaches, counted from 0; sizes below the first edge are in bin 0."""
    return F.greatest(passed(size, edges) - 1, F.lit(0)).cast("int")


def bin_size(code: Column, reps: Sequence[int]) -> Column:
    """The size that stands for a bin."""
    return looked_up(code, reps)


def flat_index(codes: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Mixed-radix cell number, the last code running fastest."""
    out = F.lit(0).cast("long")
    for c, n in zip(codes, sizes, strict=True):
        out = out * n + c
    return out


def delimited(x: Column, delimiter: str) -> Column:
    """The parts of a delimited list; an empty array for nulls and blanks. The delimiter is literal."""
    trimmed = F.trim(x)
    parts = F.split(trimmed, "\\Q" + delimiter + "\\E")
    return F.when(x.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(parts)


def first_part(x: Column, delimiter: str) -> Column:
    return F.try_element_at(delimited(x, delimiter), F.lit(1))


def labelled(code: Column, labels: Sequence[str]) -> Column:
    """The label of a code; null outside of the list."""
    return F.try_element_at(F.array(*(F.lit(x) for x in labels)), code.cast("int") + 1)


def first_of_month(year_code: Column, month_code: Column, first_year: int) -> Column:
    """The date that a year and a month code stand for."""
    return F.make_date(year_code + F.lit(first_year), month_code + 1, F.lit(1))


def spread_in_bin(code: Column, lows: Sequence[float], highs: Sequence[float], u: Column) -> Column:
    """A value inside the code's bin, at the share u of its width."""
    lo, hi = (F.element_at(F.array(*(F.lit(float(v)) for v in x)), code.cast("int") + 1) for x in (lows, highs))
    return lo + (hi - lo) * u


#: Rules that combine three bits, by name; mod4 is another name of parity.
def rules() -> dict[str, object]:
    def bits(*c: Column) -> list[Column]:
        return [x.cast("int") for x in c]

    def xor(u: Column, a: Column, b: Column) -> Column:
        u, a, b = bits(u, a, b)
        return u.bitwiseXOR(a).bitwiseXOR(b)

    def threshold(u: Column, a: Column, b: Column) -> Column:
        u, a, b = bits(u, a, b)
        return (u + a + b >= 2).cast("int")

    def either(u: Column, a: Column, b: Column) -> Column:
        u, a, b = bits(u, a, b)
        return u.bitwiseOR(a).bitwiseOR(b)

    return {"xor": xor, "mod4": xor, "threshold": threshold, "or": either}


def rule(name: str, u: Column, x1: Column, x2: Column) -> Column:
    """A named rule, or an arithmetic expression over u, x1 and x2.

    Expressions may hold those names, digits, blanks and + - * % & | ^ > < = ( ) alone; anything else is refused.
    """
    named = rules()
    if name in named:
        return named[name](u, x1, x2)
    if not name or any(c not in "ux12 0123456789+-*%&|^><=()" for c in name):
        raise ValueError(f"not a rule: {name!r}")
    return _parsed(name, {"u": u.cast("int"), "x1": x1.cast("int"), "x2": x2.cast("int")}).cast("int")


def _parsed(body: str, names: dict[str, Column]) -> Column:
    """A small expression grammar over names: | ^ & comparison + - * %, loosest first."""
    tokens = re.findall(r"x1|x2|u|\d+|>=|<=|==|[-+*%&|^<>=()]", body)
    if "".join(tokens) != body.replace(" ", ""):
        raise ValueError(f"not a rule: {body!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom() -> Column:
        t = take() if peek() else ""
        if t == "(":
            x = level(0)
            if not peek() or take() != ")":
                raise ValueError(f"unclosed bracket in {body!r}")
            return x
        if t == "-":
            return -atom()
        if t.isdigit():
            return F.lit(int(t))
        if t in names:
            return names[t]
        raise ValueError(f"not a rule: {body!r}")

    grades = (
        {"|": lambda a, b: a.bitwiseOR(b)},
        {"^": lambda a, b: a.bitwiseXOR(b)},
        {"&": lambda a, b: a.bitwiseAND(b)},
        {
            ">=": lambda a, b: (a >= b).cast("int"), "<=": lambda a, b: (a <= b).cast("int"),
            "==": lambda a, b: (a == b).cast("int"), "=": lambda a, b: (a == b).cast("int"),
            ">": lambda a, b: (a > b).cast("int"), "<": lambda a, b: (a < b).cast("int"),
        },
        {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
        {"*": lambda a, b: a * b, "%": lambda a, b: F.pmod(a, b)},
    )

    def level(k: int) -> Column:
        if k == len(grades):
            return atom()
        x = level(k + 1)
        while peek() in grades[k]:
            x = grades[k][take()](x, level(k + 1))
        return x

    out = level(0)
    if at != len(tokens):
        raise ValueError(f"not a rule: {body!r}")
    return out
