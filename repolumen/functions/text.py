"""Column helpers for text: lines, whitespace, ordered keyword rules, located matches.

Every helper maps columns to columns, so it can be used on a table column or on the
element variable of ``transform``/``filter``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\r\x0b\x0c"
MARK = "\x01"


def strip(text: Column) -> Column:
    """Remove blanks of every kind at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(BLANK))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def lines_of_code(content: Column) -> Column:
    """Lines with a visible character: each match starts at one and runs to the line's end."""
    return F.regexp_count(content, F.lit(r"\S[^\n]*"))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def first_rule(text: Column, rules, default: Column | None = None) -> Column:
    """Label of the first rule one of whose words occurs in ``text``."""
    (words, label), *rest = rules
    chain = F.when(contains_any(text, words), F.lit(label))
    for words, label in rest:
        chain = chain.when(contains_any(text, words), F.lit(label))
    return chain if default is None else chain.otherwise(default)


def in_line(pattern: str) -> str:
    """Whole-text form of a one-match-per-line pattern.

    Blanks and negated classes stop at the line's end, and the tail swallows the rest of
    the line, so a text has exactly one match per matching line.
    """
    for wide, narrow in ((r"\s", r"[^\S\n]"), (r"[^)]", r"[^)\n]"), (r"[^\]]", r"[^\]\n]"),
                         (r"[^\x22\x27]", r"[^\x22\x27\n]"), (".*", r"[^\n]*")):
        pattern = pattern.replace(wide, narrow)
    return pattern + r"[^\n]*"


def count_lines(text: Column, pattern: str, hint: Column) -> Column:
    """Number of lines in which ``pattern`` occurs. ``hint`` is a cheap test that every text with
    a match passes; other texts skip the regular expression."""
    return F.when(hint, F.regexp_count(text, F.lit(in_line(pattern)))).otherwise(F.lit(0))


def group_per_line(text: Column, pattern: str, group: int, hint: Column | None = None) -> Column:
    """The group's value for each line in which ``pattern`` occurs."""
    found = F.regexp_extract_all(text, F.lit(in_line(pattern)), F.lit(group))
    return found if hint is None else F.when(hint, found).otherwise(F.array().cast("array<string>"))


def located_matches(content: Column, pattern: str, hint: Column | None = None, **groups: int) -> Column:
    """All matches in a text, also across lines, as ``array<struct<line, ...groups>>``.

    Every match start is marked by a control character; the marks in the text's lines give the
    line numbers in match order, in time linear in the text. A control character of the text
    itself is first turned into another one, which no pattern tells apart. Groups are read from
    the matched pieces. ``hint`` as in ``count_lines``.
    """
    marked = F.regexp_replace(F.translate(content, MARK, "\x02"), pattern, MARK + "$0")
    numbered = F.transform(F.split(marked, "\n"), lambda line, i: F.struct((i + 1).alias("n"), line.alias("text")))
    lines = F.flatten(F.transform(
        F.filter(numbered, lambda s: s["text"].contains(MARK)),
        lambda s: F.array_repeat(s["n"], F.length(s["text"]) - F.length(F.replace(s["text"], F.lit(MARK), F.lit(""))))))
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    rows = F.zip_with(lines, found, lambda n, match: F.struct(n.alias("line"), *[
        (F.regexp_extract(match, pattern, group) if group else match).alias(name) for name, group in groups.items()]))
    shape = "array<struct<line:int," + ",".join(f"{name}:string" for name in groups) + ">>"
    return rows if hint is None else F.when(hint, rows).otherwise(F.array().cast(shape))


def anchors(lines: Column, matches, before: int = 0, ahead: int = 1) -> Column:
    """The matching lines with their neighbourhood: ``array<struct<pos, text, before, ahead>>``.

    ``pos`` counts from 0 and ``text`` is stripped; ``ahead`` starts with the line itself.
    Non-matching lines are dropped inside the array, so no content is copied per line.
    """
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), strip(line).alias("text")))
    hits = F.filter(numbered, lambda h: matches(h["text"]))
    return F.transform(hits, lambda h: F.struct(
        h["pos"].alias("pos"), h["text"].alias("text"),
        F.slice(lines, F.greatest(h["pos"] - before + 1, F.lit(1)), F.least(h["pos"], F.lit(before))).alias("before"),
        F.slice(lines, h["pos"] + 1, F.lit(ahead)).alias("ahead")))


def head_lines(lines: Column, n) -> Column:
    return F.slice(lines, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")
