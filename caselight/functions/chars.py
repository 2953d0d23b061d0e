"""Character semantics: Unicode-aware strip, split and regular expressions as native columns.

Patterns are written in the familiar short form (``\\s \\d \\w \\b``) with Unicode meaning, and :func:`java`
or :func:`re2` spells that meaning out for the engine that runs them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing knows it, U+001C to U+001F included.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same class for Java, which asks one range after the other: three wide ones turn nearly all other characters away.
BLANK = r"[\x00-\x20\x80-\xa0\u1680-\u3000&&" + WS + "]"
#: The same characters one after the other.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

#: Patterns of whole words, without alternatives outside of groups, that begin and end with a letter.
_WHOLE = re.compile(r"\\b[a-z](?:[^|()]|\((?:[^()])*\))*(?<!\\)[a-z]\\b\Z")
_SHORT = re.compile(r"\\[sdwbSbW]|\[[^\]]*\]")
#: A word's first letter, a run of characters of a class that holds that letter's class too, and what has to follow.
_RUN = re.compile(r"\\b\[([^\]&^]+)\]\[(\1[^\]&]*)\]\+(.+)\Z")
#: The letters that a pattern begins with; one that a quantifier follows is none of them.
_HEAD = re.compile(r"[a-z][a-z ]*(?![*+?{])")
HEADS = 4


def _spell(pattern: str, ws: str, edge: str, blank: str | None = None) -> str:
    def one(m: re.Match) -> str:
        t = m[0]
        if t[0] == "[":  # classes hold \s and \d as members
            return t.replace(r"\s", ws[1:-1]).replace(r"\d", r"\p{Nd}")
        return {r"\s": blank or ws, r"\S": "[^" + ws[1:], r"\d": r"\p{Nd}", r"\w": WORD, r"\W": NOT_WORD, r"\b": edge}[t]

    return _SHORT.sub(one, pattern)


def java(patterns: str | list[str], flags: str = "iud") -> str:
    """One alternation in Java's syntax: Unicode case folding, and ``.`` excludes only the newline.

    Whole words share one test of their edges, which fails at once inside a word. It tells whether something is found;
    what the match spans may differ from that of the patterns as they are stated.
    """
    edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    each = [patterns] if isinstance(patterns, str) else patterns
    whole = [p for p in each if _WHOLE.match(p)]
    rest = [p for p in each if p not in whole]
    single = [p for p in rest if "|" not in re.sub(r"\([^()]*\)|\[[^\]]*\]", "", p)]
    plain, edged = [p for p in single if _HEAD.match(p)], [p for p in single if p.startswith("\\b") and _HEAD.match(p[2:])]
    parts = [_spell(_once(p), WS, edge, BLANK) for p in rest if p not in plain and p not in edged]
    for some, before, after in ((plain, "", ""), ([p[2:] for p in edged], f"(?<!{WORD})", ""), ([p[2:-2] for p in whole], f"(?<!{WORD})", f"(?!{WORD})")):
        if some:
            first = heads([_HEAD.match(p)[0] if _HEAD.match(p) else "" for p in some])
            parts.insert(0, f"{first}{before}(?:{'|'.join(_spell(p, WS, edge, BLANK) for p in some)}){after}")
    return (f"(?{flags})" if flags else "") + (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})")


def _once(pattern: str) -> str:
    """A letter and a run of characters from the first place in the run only, as all later ones see the same end.

    Tried at every word, a run without that end takes the square of its length.
    """
    m = _RUN.match(pattern)
    return f"(?<![{m[2]}])(?>[{m[2]}]*?\\b[{m[1]}])[{m[2]}]+{m[3]}" if m else pattern


def heads(terms: list[str]) -> str:
    """A look ahead at the first characters of all terms: it turns most places away before each term is tried."""
    n = min(HEADS, min(map(len, terms)))
    return f"(?={''.join('[' + ''.join(re.escape(c) for c in sorted({t[i] for t in terms})) + ']' for i in range(n))})" if n else ""


def re2(patterns: str | list[str], flags: str = "i") -> str:
    """The same alternation for RE2, which has no lookaround: word edges consume a neighbour, fit for tests of presence."""
    each = [patterns] if isinstance(patterns, str) else patterns
    out = []
    for p in each:
        p = re.sub(r"^\\b", "(?:^|" + NOT_WORD.replace("\\", "\\\\") + ")", p)
        p = re.sub(r"\\b$", "(?:$|" + NOT_WORD.replace("\\", "\\\\") + ")", p)
        p = re.sub(r"\\b", "(?:$|" + NOT_WORD.replace("\\", "\\\\") + ")", p)
        out.append(_spell(p, WS_RE2, ""))
    return (f"(?{flags})" if flags else "") + "(?:" + "|".join(out) + ")"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: bound as a lambda variable, it is not inlined into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def unix_lines(c: Column) -> Column:
    """CRLF and CR as LF, as text-mode reading does."""
    return F.regexp_replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def last_n(arr: Column, n: int | Column) -> Column:
    """The last ``n`` elements; all of a shorter array."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(arr)
    return F.when(size == 0, arr).otherwise(F.slice(arr, F.greatest(size - n + 1, F.lit(1)), n))


def contains_any(c: Column, terms: list[str]) -> Column:
    """Case-insensitive presence of any term, as one alternation."""
    return has_any(F.lower(c), terms)


def has_any(low: Column, terms: list[str]) -> Column:
    """Presence of any term in a text that is in lower case already."""
    each = [t.lower() for t in terms]
    return low.rlike(f"{heads(each)}(?:{'|'.join(map(re.escape, each))})")
