"""Text helpers as column expressions: folding, LIKE, term counts, word counts, wikilinks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a wikilink looks like, and what counts as a word.
WIKILINK = r"\[\[([^\]|]+?)(?:\|[^\]]+?)?\]\]"
CJK_CHAR = r"[\u3000-\u9fff\uf900-\ufaff\uff66-\uff9f]"
ASCII_WORD = r"[a-zA-Z0-9]+"


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, _UPPER, _LOWER)


def fold(text: Column) -> Column:
    """Case folding, one character for one: the two letters that ``lower`` lengthens or changes by context are put right first."""
    # Replacing a sign that is hardly ever there costs a scan; translating looks at every character.
    for sign, by in (("İ", "i"), ("Σ", "σ"), ("ς", "σ")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return F.lower(text)


def _quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def fold_term(term: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in term.translate({0x130: "i", 0x3A3: "σ", 0x3C2: "σ"}))


def like_any(text: Column, keyword: str, mode: str = "compat") -> Column:
    """Whether ``text`` contains ``keyword``, letter case aside.

    ``compat``: the keyword in Unicode lower case, the text in ASCII lower case, and ``%`` and ``_`` in the keyword
    act as wildcards. ``literal``: every sign stands for itself and both sides fold fully.
    """
    if mode == "literal":
        return fold(text).contains(fold_term(keyword))
    pattern = f"%{keyword.lower()}%"
    low = keyword.lower()
    if not any(c in keyword for c in "%_"):
        # Without the flag for Unicode, a pattern's letter case is ignored for A to Z only.
        return F.rlike(text, F.lit(f"(?i){_quoted(low)}")) if any("a" <= c <= "z" for c in low) else text.contains(low)
    escape = next(c for c in "~^|!@\x01" if c not in pattern)
    return F.like(ascii_lower(text), F.lit(pattern), F.lit(escape))


def split_terms(query: str) -> list[str]:
    """The terms of a query, split at Unicode white space; a query of nothing else is one term."""
    return query.split() or [query]


def occurrences(folded: Column, term: str) -> Column:
    """How often a folded term occurs in folded text, overlapping ones included."""
    if not _overlaps_itself(term):
        return ((F.length(folded) - F.length(F.replace(folded, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")
    return F.regexp_count(folded, F.lit(f"(?={_quoted(term)})")).cast("long")


def _overlaps_itself(term: str) -> bool:
    return any(term[i:] == term[: len(term) - i] for i in range(1, len(term)))


def word_count(body: Column) -> Column:
    """CJK characters plus runs of ASCII letters and digits."""
    return (F.regexp_count(body, F.lit(CJK_CHAR)) + F.regexp_count(body, F.lit(ASCII_WORD))).cast("long")


def wikilinks(body: Column) -> Column:
    """The distinct raw targets of a body's wikilinks in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1))))


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def embedding_text(title: Column, summary: Column, body: Column, prefix: str = "") -> Column:
    """What is embedded of a note: title, summary and body in lines, trimmed, behind the passage prefix."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(prefix), trim(F.concat_ws("\n", blank(title), blank(summary), blank(body))))


def count_words(text: str) -> int:
    """:func:`word_count` of one string on the driver."""
    return len(re.findall(CJK_CHAR, text)) + len(re.findall(ASCII_WORD, text))
