"""Shell-style patterns as Spark predicates.

A pattern is parsed once; what it needs decides the predicate: equality, prefix, suffix and containment
tests reach Parquet as pushed filters, anything else becomes one anchored regular expression.

``?`` one character, ``*`` any run, ``**`` as a path component any number of components, ``{a,b}``
alternatives, ``[ab]``, ``[a-z]``, ``[!ab]`` classes, ``\\x`` the character x.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that can't be read."""


@dataclass(frozen=True)
class Glob:
    """regex: body without anchors; shape: literal pieces between plain stars, or None where more is needed."""

    pattern: str
    regex: str
    shape: tuple[str, ...] | None

    def matches(self, text: str) -> bool:
        return re.fullmatch(f"(?s:{self.regex})", text) is not None

    def column(self, c: Column) -> Column:
        """The predicate; null where c is."""
        if self.shape is not None:
            first, *rest = self.shape
            if not rest:
                return c == F.lit(first)
            if len(rest) == 1:
                parts = [c.startswith(first)] * bool(first) + [c.endswith(rest[0])] * bool(rest[0])
                if len(parts) == 2:  # both ends must have their own characters
                    parts.append(F.length(c) >= len(first) + len(rest[0]))
                out = parts[0] if parts else c.isNotNull()
                for p in parts[1:]:
                    out = out & p
                return out
            if self.shape[0] == self.shape[-1] == "" and len(self.shape) == 3:
                return c.contains(self.shape[1])
        return c.rlike(rf"(?s)^(?:{self.regex})\z")


def escape(text: str) -> str:
    """The pattern that matches this text only, for texts without braces and backslashes."""
    return re.sub(r"([?*\[\]])", r"[\1]", text)


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The regex of the class that opens before i, and where it ends."""
    negated = pattern[i : i + 1] in ("!", "^")
    i += negated
    items: list[str] = []
    start = i
    while True:
        if i >= len(pattern):
            raise GlobError(f"unclosed character class in {pattern!r}")
        if pattern[i] == "]" and i > start:
            break
        if i + 2 < len(pattern) and pattern[i + 1] == "-" and pattern[i + 2] != "]":
            lo, hi = pattern[i], pattern[i + 2]
            if lo > hi:
                raise GlobError(f"invalid range {lo}-{hi} in {pattern!r}")
            items.append(f"\\x{{{ord(lo):X}}}-\\x{{{ord(hi):X}}}")
            i += 3
        else:
            items.append(f"\\x{{{ord(pattern[i]):X}}}")
            i += 1
    return f"[{'^' if negated else ''}{''.join(items)}]", i + 1


def _literal(ch: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", ch) if ch.isascii() else ch


def parse(pattern: str, separator_is_literal: bool = False) -> Glob:
    """separator_is_literal: whether * and ? stop at a slash."""
    one, many = ("[^/]", "[^/]*") if separator_is_literal else (".", ".*")
    out: list[str] = []
    pieces: list[str] | None = [""]
    depth, i, n = 0, 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            opens = i == 0 or pattern[i - 1] == "/"
            if j - i == 2 and opens and (j == n or pattern[j] == "/"):
                pieces = None
                if j < n:  # "**/": any number of leading components
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(many)
                if pieces is not None:
                    pieces = None if separator_is_literal else [*pieces, ""]
            i = j
            continue
        if ch == "?":
            out.append(one)
            pieces = None
        elif ch == "[":
            text, i = _class(pattern, i + 1)
            out.append(text)
            pieces = None
            continue
        elif ch == "{":
            depth += 1
            out.append("(?:")
            pieces = None
        elif ch == "}":
            if not depth:
                raise GlobError(f"unopened alternation in {pattern!r}")
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        else:
            if ch == "\\":
                i += 1
                if i >= n:
                    raise GlobError(f"dangling escape in {pattern!r}")
                ch = pattern[i]
            out.append(_literal(ch))
            if pieces is not None:
                pieces[-1] += ch
        i += 1
    if depth:
        raise GlobError(f"unclosed alternation in {pattern!r}")
    regex = "".join(out)
    # Java and Python agree on all of this but the brace form of code points, which Python lacks.
    body = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", regex)
    re.compile(body)
    return _Compiled(pattern, regex, tuple(pieces) if pieces is not None else None)


class _Compiled(Glob):
    def matches(self, text: str) -> bool:
        body = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", self.regex)
        return re.fullmatch(f"(?s:{body})", text) is not None


def exclusion(pattern: str) -> Glob:
    """An exclusion pattern over absolute paths: a bare name applies in every directory; any other must start at the root or with **/."""
    if not pattern or pattern == "/":
        raise GlobError("an exclusion can't be empty or the root")
    if pattern.endswith("/"):
        raise GlobError(f"exclusion {pattern!r} ends with a slash")
    if "/" not in pattern:
        pattern = f"**/{pattern}"
    elif not pattern.startswith(("/", "**/")):
        raise GlobError(f"exclusion {pattern!r} has a slash, so it must start with / or **/")
    return parse(pattern, separator_is_literal=True)


def any_of(globs: list[Glob], c: Column) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.coalesce(g.column(c), F.lit(False))
    return out
