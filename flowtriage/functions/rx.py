"""Regex and string helpers that pin one dialect for the whole package.

The texts this engine reads follow Python's regex rules: ``.`` stops at ``\\n``
only, ``\\s``/``\\w``/``\\d`` are Unicode classes, ignoring case is Unicode-aware.
Java needs the flags below to agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtriage.functions import sql

IGNORE_CASE = "(?iudU)"
KEEP_CASE = "(?dU)"
MULTILINE = "(?mdU)"
PLAIN = "(?d)"

# Unicode white space as Python's str.strip sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Non-ASCII letters that equal an ASCII letter when case is ignored:
# long s, dotless i, dotted capital I, Kelvin sign.
_FOLD_FROM = "\u017f\u0131\u0130\u212a"
_FOLD_TO = "siik"

_LITERAL_PREFIX = re.compile(r"(?:[^\[\](){}?*+|^$.\\]|\\\.)*")


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def fold(col: Column) -> Column:
    """Lower-cased text on which an ASCII pattern ignores case exactly."""
    return F.lower(F.translate(col, _FOLD_FROM, _FOLD_TO))


def hits(column: str, pattern: str) -> str:
    """SQL test whether a pattern occurs in a folded text column, ignoring case.

    The longest string every match must hold is looked for first: Java scans
    for a plain string with skips, while ``a.*b`` patterns backtrack, and most
    texts hold none of the strings.
    """
    full = f"{column} RLIKE {sql.regex(folded_regex(pattern))}"
    literals = _required_literals(pattern)
    if not literals:
        return f"({full})"
    longest = max(literals, key=len)
    gate = f"{column} RLIKE {sql.regex(longest.replace('.', chr(92) + '.'))}"
    is_literal = longest == pattern.replace(r"\.", ".").lower()
    return f"({gate})" if is_literal else f"({gate} AND {full})"


def gate(pattern: str) -> str:
    """The longest string that any folded text matching the pattern must hold; empty if none is known."""
    return max(_required_literals(pattern), key=len, default="")


def hits_any(column: str, patterns) -> str:
    return "(" + " OR ".join(hits(column, p) for p in patterns) + ")"


def first(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Group 1 of the first match, NULL without a match.

    Every pattern used here captures at least one character, so an empty
    extraction can only mean that nothing matched.
    """
    flags = IGNORE_CASE if ignore_case else KEEP_CASE
    return F.nullif(F.regexp_extract(col, flags + pattern, 1), F.lit(""))


def first_folded(folded: Column, pattern: str) -> Column:
    """Like :func:`first`, on folded text; the result is folded, too."""
    return F.nullif(F.regexp_extract(folded, folded_regex(pattern), 1), F.lit(""))


def as_long(col: Column) -> Column:
    return col.try_cast("bigint")


def as_double(col: Column) -> Column:
    return col.try_cast("double")


def _required_literals(pattern: str) -> list[str]:
    """Lower-case strings that any text matching the pattern must hold."""
    outside_groups = re.sub(r"\([^()]*\)", "", pattern)
    if not pattern.isascii() or "|" in outside_groups or re.search(r"\([^)]*\.\*", pattern):
        return []
    literals = []
    for piece in pattern.split(".*"):
        literal = _LITERAL_PREFIX.match(piece)[0]
        if piece[len(literal):][:1] in ("?", "*", "{"):
            literal = literal[:-1]
        if literal and not literal.endswith("\\"):
            literals.append(literal.replace(r"\.", ".").lower())
    return literals


def folded_regex(pattern: str) -> str:
    """The pattern for folded text: case-sensitive, which Java matches faster."""
    if not pattern.isascii() or re.search(r"\\[pPxu]", pattern):
        return IGNORE_CASE + pattern
    flags = KEEP_CASE if re.search(r"\\[swdb]", pattern, re.I) else PLAIN
    # Only literal letters are lower-cased: \S and the like keep their meaning.
    return flags + re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)
