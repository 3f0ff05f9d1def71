"""Parts of texts: cuts at natural ends, what stands below headings, and the window that fits a query best.

Lengths are characters, so no code point is cut in two. Null texts give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\r\n\x0b\x0c"
#: A paragraph shorter than this before the best one is taken along.
SHORT = 100


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def _with(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut in their last 30 % at the last paragraph's end, else sentence's, line's or word's."""
    start = most * 7 // 10

    def cut(tail: Column) -> Column:
        head = F.left(text, F.lit(start))
        back = F.reverse(tail)

        def last(mark: str) -> Column:
            """What is before the last ``mark``; null if there is none. The marks read the same from behind."""
            at = F.instr(back, mark)
            return F.when(at > 0, F.concat(head, F.left(tail, F.length(tail) - at - len(mark) + 1)))

        sentence = F.regexp_extract(tail, r"(?s)^(.*[.!?])[ \n]", 1)
        end = F.coalesce(last("\n\n"), F.when(sentence != "", F.concat(head, sentence)), last("\n"), last(" "))
        return F.when(end.isNotNull(), _trim(end)).otherwise(F.left(text, F.lit(most)))

    return F.when(F.length(text) <= most, text).otherwise(_with(F.substring(text, start + 1, most - start), cut))


def without_headings(text: Column) -> Column:
    """The text from the first of its first twenty lines on that is neither blank nor a heading; empty if all are."""

    def rest(lines: Column) -> Column:
        content = F.array_position(F.transform(lines, lambda x: ~((_trim(x) == "") | _trim(x).startswith("#"))), F.lit(True))
        return F.when(content == 0, F.lit("")).otherwise(_trim(F.array_join(F.slice(lines, F.greatest(content, F.lit(1)).cast("int"), F.size(lines)), "\n")))

    return F.when(text.isNotNull(), _with(F.split(text, "\n", 20), rest))


def coverage(text: Column, terms: Column) -> Column:
    """The share of terms that a text has, whatever the case; 0 without terms."""
    low = F.lower(text)
    found = F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(found / F.size(terms))


def snippet(text: Column, words: Column, most: int) -> Column:
    """At most ``most`` characters from the paragraph (or line, where there is one paragraph) with the most words of a query, and a short one before it.

    The first of equal ones counts; without any word it begins with the text.
    """

    def window(body: Column) -> Column:
        two = F.size(F.split(body, "\n\n")) > 1
        joined = lambda p: F.when(two, F.array_join(p, "\n\n")).otherwise(F.array_join(p, "\n"))
        parts = F.when(two, F.split(body, "\n\n")).otherwise(F.split(body, "\n"))

        def best(p: Column) -> Column:
            scores = F.transform(p, lambda x: F.size(F.filter(words, lambda w: F.contains(F.lower(x), F.lower(w)))))

            def begin(s: Column) -> Column:
                at = F.array_position(s, F.array_max(s)).cast("int")
                before = F.get(p, at - 2)
                first = F.when((at > 1) & (F.length(before) < SHORT), at - 1).otherwise(at)
                return F.when(F.array_max(s) == 0, body).otherwise(joined(F.slice(p, first, F.size(p))))

            return _with(scores, begin)

        return F.when(F.length(body) <= most, body).otherwise(_with(F.when(F.size(words) == 0, body).otherwise(_with(parts, best)), lambda x: truncate(x, most)))

    return F.when(text.isNotNull(), _with(without_headings(text), window))
