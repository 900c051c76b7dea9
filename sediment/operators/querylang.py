"""The tag-query language: parser, tree and compiler to Spark predicates.

    query := and                 and  := or ("and" or)*          or := term ("or" term)*
    term  := "[" and "]" | "~" term | ("older-than" | "newer-than") duration | tag ("=" glob | "==" text)

Words are separate arguments, joined by SEPARATOR. `or` binds tighter than `and`. Predicates have two
values only: a test of a missing tag is false, and its negation true.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import globs

SEPARATOR = "•"
#: Fixed values of the duration format, in nanoseconds: a month is 30.44 days, a year 365.25.
_S = 10**9
UNITS = {
    **dict.fromkeys(("nsec", "ns"), 1),
    **dict.fromkeys(("usec", "us"), 10**3),
    **dict.fromkeys(("msec", "ms"), 10**6),
    **dict.fromkeys(("seconds", "second", "sec", "s"), _S),
    **dict.fromkeys(("minutes", "minute", "min", "m"), 60 * _S),
    **dict.fromkeys(("hours", "hour", "hr", "h"), 3600 * _S),
    **dict.fromkeys(("days", "day", "d"), 86400 * _S),
    **dict.fromkeys(("weeks", "week", "w"), 7 * 86400 * _S),
    **dict.fromkeys(("months", "month", "M"), 2_630_016 * _S),
    **dict.fromkeys(("years", "year", "y"), 31_557_600 * _S),
}


class QuerySyntaxError(ValueError):
    """A query that can't be read; span holds the first and last character concerned."""

    def __init__(self, message: str, span: tuple[int, int], text: str = ""):
        super().__init__(message)
        self.message, self.span, self.text = message, span, text

    def pretty(self) -> str:
        shown = self.text.replace(SEPARATOR, " ")
        return f"{self.message}\n  {shown}\n  {' ' * self.span[0]}{'^' * max(1, self.span[1] - self.span[0])}"


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class Tag:
    key: str
    value: str
    literal: bool


@dataclass(frozen=True)
class Age:
    older: bool
    nanos: int


def parse_duration(text: str) -> int:
    """Nanoseconds of whole numbers with units, such as `1h 30m`."""
    parts = re.findall(r"\s*(\d+)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"\s*\d+\s*[A-Za-z]+", "", text).strip():
        raise ValueError(f"invalid duration {text!r}")
    if unknown := [u for _, u in parts if u not in UNITS]:
        raise ValueError(f"unknown unit {unknown[0]!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, message: str, start: int | None = None, stop: int | None = None):
        a = self.at if start is None else start
        raise QuerySyntaxError(message, (a, max(a + 1, stop or self.at)), self.text)

    def take(self, pattern: str) -> re.Match | None:
        if m := re.compile(pattern).match(self.text, self.at):
            self.at = m.end()
        return m

    def query(self):
        out = self.chain("and", And, lambda: self.chain("or", Or, self.term))
        if self.at < len(self.text):
            self.fail("unexpected input after the query", stop=len(self.text))
        return out

    def chain(self, word: str, node: type, part: Callable):
        out = part()
        while self.take(word + SEPARATOR):
            out = node(out, part())
        return out

    def term(self):
        start = self.at
        if self.take(rf"\[{SEPARATOR}?"):
            out = self.chain("and", And, lambda: self.chain("or", Or, self.term))
            if not self.take(rf"\]{SEPARATOR}?"):
                self.fail("expected ']'")
            return out
        if self.take(rf"~{SEPARATOR}?"):
            return Not(self.term())
        if m := self.take(rf"(older|newer)-than{SEPARATOR}"):
            begin = self.at
            value = self.take(rf"[^{SEPARATOR}]*")[0]
            try:
                nanos = parse_duration(value)
            except ValueError as e:
                self.fail(str(e), begin)
            self.take(SEPARATOR)
            return Age(m[1] == "older", nanos)
        if m := self.take(r"([A-Za-z0-9_-]+)(==|=)"):
            begin = self.at
            value = self.take(rf"[^{SEPARATOR}]*")[0]
            if m[2] == "=":
                try:
                    globs.parse(value)
                except globs.GlobError as e:
                    self.fail(str(e), begin)
            self.take(SEPARATOR)
            return Tag(m[1], value, m[2] == "==")
        self.at = min(len(self.text), start + 1)
        self.fail("expected a tag test, '~', '[', older-than or newer-than", start)


def parse(query: str | list[str] | tuple[str, ...]):
    """The tree of a query, given as arguments or already joined."""
    return _Parser(query if isinstance(query, str) else SEPARATOR.join(query)).query()


def map_lookup(tags: Column) -> Callable[[str], Column]:
    return lambda key: F.try_element_at(tags, F.lit(key))


def compile_query(tree, lookup: Callable[[str], Column], age_nanos: Column | None = None, encrypted: bool = False) -> Column:
    """The predicate of a tree. lookup: the column of a tag, null where it is missing. Encrypted items have no ages: tests of them are false."""
    if isinstance(tree, And):
        return compile_query(tree.left, lookup, age_nanos, encrypted) & compile_query(tree.right, lookup, age_nanos, encrypted)
    if isinstance(tree, Or):
        return compile_query(tree.left, lookup, age_nanos, encrypted) | compile_query(tree.right, lookup, age_nanos, encrypted)
    if isinstance(tree, Not):
        return ~compile_query(tree.term, lookup, age_nanos, encrypted)
    if isinstance(tree, Age):
        if encrypted or age_nanos is None:
            return F.lit(False)
        test = age_nanos > F.lit(tree.nanos) if tree.older else age_nanos < F.lit(tree.nanos)
        return age_nanos.isNotNull() & test
    value = lookup(tree.key)
    # Two-valued, and of tests that reach the scan, also below a negation.
    return value.isNotNull() & (value == F.lit(tree.value) if tree.literal else globs.parse(tree.value).column(value))


def evaluate(tree, tags: dict[str, str], age_nanos: int, encrypted: bool = False) -> bool:
    """The same on one item, without Spark."""
    if isinstance(tree, And):
        return evaluate(tree.left, tags, age_nanos, encrypted) and evaluate(tree.right, tags, age_nanos, encrypted)
    if isinstance(tree, Or):
        return evaluate(tree.left, tags, age_nanos, encrypted) or evaluate(tree.right, tags, age_nanos, encrypted)
    if isinstance(tree, Not):
        return not evaluate(tree.term, tags, age_nanos, encrypted)
    if isinstance(tree, Age):
        return not encrypted and (age_nanos > tree.nanos if tree.older else age_nanos < tree.nanos)
    if tree.key not in tags:
        return False
    return tags[tree.key] == tree.value if tree.literal else globs.parse(tree.value).matches(tags[tree.key])


def single_id(tree) -> str | None:
    """The item id of a query that is nothing but `id=<32 hex digits>`, in lower case: such a query needs no scan."""
    if isinstance(tree, Tag) and tree.key == "id" and re.fullmatch(r"[0-9A-Fa-f]{32}", tree.value):
        return tree.value.lower()
    return None


PUT_TAG = re.compile(r"^([A-Za-z0-9_-]+)=(.+)$", re.S)
RESERVED = frozenset({"id", "timestamp", "size", "decryption-key-id"})


def parse_put_tags(args: list[str]) -> tuple[dict[str, str], list[str]]:
    """Leading name=value arguments as tags, and the other arguments; `::` ends the tags."""
    tags: dict[str, str] = {}
    for k, arg in enumerate(args):
        if arg == "::":
            return tags, args[k + 1 :]
        if not (m := PUT_TAG.match(arg)):
            return tags, args[k:]
        if m[1] in RESERVED:
            raise ValueError(f"the tag {m[1]!r} is reserved")
        tags[m[1]] = m[2]
    return tags, []
