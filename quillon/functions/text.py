"""Text columns: terms of queries, tokens, boundaries that mean the same in every regex dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a query, and short ones that do.
STOP_WORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might shall can of in to for with on at from by about as into "
    "through during and or but not so what how when where which who whom this that these those it its my your our their i me we you he she they them explain "
    "describe tell show work works tracked area project help find search".split()
)
SHORT_TERMS = frozenset("ai os pm qa ui ux hr ml".split())
TRIM = ".,;:!?\"'()[]{}"
_WORD = "[0-9A-Za-z_]"
#: An ASCII word boundary; Java's own is not ASCII-only.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def search_terms(query: str) -> list[str]:
    """Terms of a query given as a plain string; the same rule as ``term_array``."""
    out: list[str] = []
    for w in query.split():
        t = w.lower().strip(TRIM)
        if len(t) >= 2 and (len(t) > 2 or t in SHORT_TERMS) and t not in STOP_WORDS and t not in out:
            out.append(t)
    return out


def term_array(text: Column) -> Column:
    """Terms of a column of queries: split, lower, trim, drop stop words and short ones, first of each."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(TRIM)))
    short = F.array(*map(F.lit, sorted(SHORT_TERMS)))
    stop = F.array(*map(F.lit, sorted(STOP_WORDS)))
    keep = lambda t: (F.length(t) >= 2) & ((F.length(t) > 2) | F.array_contains(short, t)) & ~F.array_contains(stop, t)
    return F.array_distinct(F.filter(words, keep))


def title_words(query: str) -> list[str]:
    """Query words for title matching: word characters, three at least (or a listed pair), no stop words."""
    return [w for w in re.findall(r"[0-9A-Za-z_]+", query) if (len(w) >= 3 or w.lower() in SHORT_TERMS) and w.lower() not in STOP_WORDS]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, for the text index."""
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda t: t != "")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_slug(text: Column, words: int = 5, letters: int = 50) -> Column:
    """The first words of the first line as a name of a file."""
    first = F.array_join(F.slice(F.filter(F.split(F.substring_index(text, "\n", 1), r"\s+"), lambda w: w != ""), 1, words), "-")
    plain = F.btrim(F.regexp_replace(F.lower(first), "[^a-z0-9-]", ""), F.lit("-"))
    return F.rtrim(F.left(plain, F.lit(letters)), F.lit("-"))


def normalized(text: Column) -> Column:
    """Dashes and underscores as blanks, runs of white space as one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[\u2014\u2013_-]", " "), r"\s+", " "))


def file_title(name: Column) -> Column:
    """What a file's name says, without a date in front, in lower case."""
    return F.lower(normalized(F.regexp_replace(name, r"^\d{4}[-_]\d{2}[-_]\d{2}[-_ ]*", "")))


def relative_age(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    days = F.floor(hours / 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(hours < 1, "just now").when(hours == 1, "1 hour ago").when(hours < 24, ago(hours, "hours")).when(days == 1, "yesterday").otherwise(ago(days, "days"))


def leading_date(text: Column) -> Column:
    """The date that a text begins with, written with dashes or slashes; null if there is none."""
    head = F.left(F.btrim(text), F.lit(10))
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyy/MM/dd"))


def parse_date(text: Column) -> Column:
    """A date written in any of three ways, else null."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/MM/dd"), F.to_date(F.try_to_timestamp(text)))


def content_type(path: Column, explicit: Column, tags: Column) -> Column:
    """The explicit type, else what the path says, else what the tags say, else note."""
    p = F.lower(path)
    out = F.when(F.coalesce(explicit, F.lit("")) != "", explicit)
    for kind, parts in (
        ("handoff", ("handoff", "session")), ("decision", ("decision",)), ("research", ("research",)),
        ("project", ("project",)), ("hub", ("hub", "moc", "index")), ("kaizen", ("kaizen",)),
    ):
        found = F.lit(False)
        for x in parts:
            found = found | p.contains(x)
        out = out.when(found, kind)
    lower = F.transform(tags, lambda t: F.lower(t))
    for kind in ("decision", "handoff", "research", "project", "hub", "kaizen"):
        out = out.when(F.array_contains(lower, kind), kind)
    return out.otherwise("note")


def strip_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"\A(?:#+[^\n]*\n+)+", "")


def neutral_tags(text: Column) -> Column:
    """Angle brackets of markup-like tags become harmless signs, so stored text can't pose as instructions."""
    return F.regexp_replace(text, r"<(/?[A-Za-z][^<>]*)>", "[$1]")


#: Tags that frame contexts and instructions for models, and other marks that models take for such.
FRAMES = (
    "vault-context", "plugin-context", "session-bootstrap", "vault-handoff", "vault-decisions", "vault-staleness", "vault-source-divergence", "system-reminder", "system", "instructions",
    "tool_result", "tool_use", "important",
)
MARKS = {"[inst]": "[[inst]]", "[/inst]": "[[/inst]]", "<<sys>>": "[[sys]]", "<</sys>>": "[[/sys]]", "<![cdata[": "[CDATA[", "]]>": "]]&gt;"}


def neutral_frames(text: Column, frames: tuple[str, ...] = FRAMES) -> Column:
    """Tags that frame contexts, and marks of instructions, made harmless, whatever their case; all other text stays as it is."""
    out = text
    for mark, plain in MARKS.items():
        # each mark is replaced once: what stands for a mark is not looked at again
        guard = r"(?<!\[)" if mark.startswith("[") else ""
        out = F.regexp_replace(out, f"(?i){guard}{re.escape(mark)}", re.sub(r"([\\$])", r"\\\1", plain))
    names = "|".join(map(re.escape, frames))
    closed = F.regexp_replace(out, f"(?i)<(/(?:{names}))>", "[$1]")
    single = F.regexp_replace(closed, f"(?i)<((?:{names})/?)>", "[$1]")
    return F.regexp_replace(single, f"(?i)<((?:{names})) ", "[$1 ")


def without_injection(text: Column, phrases: list[str]) -> Column:
    """A text, or a note that it was left out if it holds one of the phrases, whatever the case."""
    bad = F.lit(False)
    for p in phrases:
        bad = bad | F.lower(text).contains(p.lower())
    return F.when(bad, "[content filtered for security]").otherwise(text)


def shared_stem(a: Column, b: Column) -> Column:
    """Both have five characters at least, differ by three in length at most, and agree on all but the last of the shorter."""
    shorter = F.least(F.length(a), F.length(b))
    need = F.greatest(shorter - 1, F.lit(5))
    return (shorter >= 5) & (F.abs(F.length(a) - F.length(b)) <= 3) & (F.left(a, need) == F.left(b, need))
