"""What a prompt is about: its terms, the mode it speaks in, and whether it asks for what is recent, of some type, or in some state.

All are columns over a column of prompts. Patterns are ASCII; null prompts give null or empty arrays, as stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import ascii_boundaries

#: Words and abbreviations that say nothing in a prompt.
STOP = tuple(
    "about above after again being below between could doing during every found going having might never other should their there these thing think those under "
    "until using where which while would write yours really please right since still today".split()
)
PLAIN_ACRONYMS = ("the", "and", "for", "not", "api")
TECH_ACRONYMS = tuple(
    "tcp udp http https ssh ftp dns ssl tls ip smtp imap grpc ws wss json xml csv html css sql yaml toml svg pdf aws gcp vpc cdn iam ec2 ecs eks rds sqs sns alb elb nat "
    "cli sdk ide jwt url uri dom orm oop tdd bdd ddd mvp mvc gpu cpu ram ssd hdd ci cd os vm rest".split()
)
HYPHENATED = (
    "three-way", "two-way", "one-way", "real-time", "non-blocking", "multi-threaded", "single-threaded", "open-source", "built-in", "read-only", "read-write", "write-only",
    "end-to-end", "peer-to-peer", "point-to-point", "client-side", "server-side", "front-end", "back-end", "full-stack", "high-level", "low-level", "long-running", "well-known",
    "re-use", "re-run", "pre-built",
)
NOT_SHOWN = tuple(
    "what when where which while with would could should about after before being between both each from have having here into just like make more most need only other "
    "over same some such than that their them then there these they this those through under very want were will your also been does done going help know look many much "
    "show tell think using work".split()
)
#: Prompts, and words of short prompts, that ask for nothing.
PHRASES = (
    "hi", "hey", "hello", "howdy", "thanks", "thank you", "thanks a lot", "thank you so much", "ok", "okay", "k", "got it", "understood", "yes", "yeah", "yep", "yup", "no",
    "nah", "nope", "sure", "sure thing", "of course", "great", "perfect", "awesome", "nice", "cool", "sounds good", "looks good", "that works", "works for me", "good job",
    "great job", "well done", "nice work", "go ahead", "go on", "continue", "proceed", "next", "i see", "makes sense", "fair enough", "good morning", "good afternoon",
    "good evening", "good night", "bye", "goodbye", "see you", "later", "cheers", "please continue", "please proceed", "please go ahead", "lgtm", "sgtm", "ty", "thx", "np", "yw",
)
SOCIAL = tuple(
    "hi hey hello howdy thanks thank you so much a lot ok okay got it yes yeah yep yup no nah nope sure great perfect awesome nice cool good sounds looks that works for me "
    "go ahead on continue proceed next please see makes sense fair enough morning afternoon evening night bye goodbye later cheers lgtm sgtm ty thx np yw well done job work".split()
)
#: How tasks, judgements and questions are worded.
VERBS = r"\b(fix|build|create|implement|add|remove|delete|update|refactor|write|run|deploy|install|move|rename|replace|change|set|configure|wire|ship|push|commit|merge|rebase)\b"
TASKS = (
    r"\b(make it .{3,30}|start with|can you .{3,30}(fix|build|add|create|implement|change|update|write|run)|could you .{3,30}(fix|build|add|create|implement|change|update|write|run)"
    r"|please .{3,20}(fix|build|add|create|implement|change|update|write|run))\b"
)
JUDGED = (
    r"\b(recommend\w*|risk\w*|benefit\w*|tradeoff\w*|trade-off\w*|pros|cons|swot|assess\w*|evaluat\w*|compar\w*|versus|should we|worth|downside|upside|concern\w*|implication\w*"
    r"|consequence\w*|alternativ\w*|option\w*|strateg\w*|approach\w*|architect\w*|design|principle\w*|philosophy)\b"
)
JUDGING = r"\b(what do you think|what are the|is this the right|is there a better|what would|how should|what if|are there any|what.?s your|whats the|what is your)\b"
ASKING = r"^(what|where|how|who|when|why|which|tell me|show me|explain|describe|walk me)"
ASKED = r"\b(what is|how does|where are|can you explain|tell me about|show me the|walk me through|what about)\b"
SHORT = 15
#: Words for what is recent, for types (with their factor), for states of trust, for doubt, and for where things come from.
RECENT = (
    "recent", "recently", "lately", "today", "yesterday", "this week", "last week", "this month", "last month", "last session", "previous session", "earlier today", "worked on",
    "changed", "modified", "updated", "latest", "newest", "last time", "last night", "left off", "up to speed", "catch me up", "where were we", "bring me up", "what happened",
    "handoff", "hand off", "hand-off",
)
TYPES = {
    ("handoff", 1.3): ("session", "handoff", "hand-off", "last session", "working on", "left off", "leave off", "pick up"),
    ("decision", 1.3): ("decided", "decide", "decision", "chose", "choose", "why did we", "choice"),
    ("meeting", 1.2): ("meeting", "discussed", "sprint"),
}
STALE = ("stale", "outdated", "old", "deprecated")
STATES = {
    "stale": "stale", "stale notes": "stale", "stale doc": "stale", "outdated": "stale", "contradicted": "contradicted", "contradiction": "contradicted", "validated": "validated",
    "verified": "validated", "superseded": "stale", "deprecated": "stale",
}
DOUBT = ("low confidence", "unreliable", "uncertain", "least confident", "least reliable", "low trust")
ORIGIN = ("provenance", "source tracking", "where did this come from", "trust state", "trust status")


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_boundaries(pattern)), F.lit(group))


def _in(x: Column, words: tuple[str, ...]) -> Column:
    return F.lower(x).isin(*words)


def key_terms(prompt: Column) -> Column:
    """struct(specific, broad): quoted phrases, acronyms and hyphenated terms, and other words of five letters; each once, whatever its case."""
    quoted = F.filter(F.transform(_found(prompt, '"([^"]+)"', 1), lambda t: F.btrim(t)), lambda t: F.octet_length(t) >= 2)
    acronyms = F.filter(_found(prompt, r"\b[A-Z]{2,}\b"), lambda t: ~_in(t, PLAIN_ACRONYMS + TECH_ACRONYMS))
    joined = F.filter(_found(prompt, r"\b\w+-\w+(?:-\w+)*\b"), lambda t: ~_in(t, HYPHENATED))
    words = F.filter(_found(prompt, r"\b[a-zA-Z]{5,}\b"), lambda t: ~_in(t, STOP))
    kind = lambda terms, broad: F.transform(terms, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), F.lit(broad).alias("broad")))
    every = F.concat(kind(F.concat(quoted, acronyms, joined), False), kind(words, True))

    def first(all_: Column) -> Column:
        lows = F.transform(all_, lambda x: x["low"])
        once = F.filter(all_, lambda x, i: F.array_position(lows, x["low"]) == i + 1)
        part = lambda broad: F.transform(F.filter(once, lambda x: x["broad"] == broad), lambda x: x["t"])
        return F.struct(part(False).alias("specific"), part(True).alias("broad"))

    return F.get(F.transform(F.array(F.coalesce(every, kind(F.array().cast("array<string>"), True))), first), F.lit(0))


def low_signal(prompt: Column) -> Column:
    terms = key_terms(prompt)
    return (F.size(terms["specific"]) == 0) & (F.size(terms["broad"]) <= 1)


def small_talk(prompt: Column) -> Column:
    """A known phrase, or five words at most that all belong to such phrases."""
    ends = F.lit(".!?,;:")
    plain = F.rtrim(F.btrim(F.lower(prompt), F.lit(" \t\r\n")), ends)
    words = F.transform(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), lambda w: F.rtrim(w, ends))
    return F.coalesce(plain.isin(*PHRASES) | ((F.size(words) <= 5) & F.forall(words, lambda w: w.isin(*SOCIAL))), F.lit(False))


def shown_terms(prompt: Column, most: int = 5) -> Column:
    """Quoted phrases and words of four letters to be shown, each once: all of the first, and the others until there are ``most``, but one at least."""
    quoted = F.filter(F.transform(_found(prompt, '"([^"]+)"', 1), lambda t: F.btrim(t)), lambda t: F.octet_length(t) >= 2)
    words = F.filter(_found(prompt, r"\b[a-zA-Z]{4,}\b"), lambda t: ~_in(t, NOT_SHOWN))

    def once(terms: Column) -> Column:
        lows = F.transform(terms, lambda t: F.lower(t))
        return F.filter(terms, lambda t, i: F.array_position(lows, F.lower(t)) == i + 1)

    def cut(q: Column) -> Column:
        lows = F.transform(q, lambda t: F.lower(t))
        rest = F.filter(once(words), lambda w: ~F.array_contains(lows, F.lower(w)))
        return F.concat(q, F.slice(rest, F.lit(1), F.greatest(F.lit(most) - F.size(q), F.lit(1))))

    return F.get(F.transform(F.array(once(quoted)), cut), F.lit(0))


def matched_terms(terms: Column, title: Column, text: Column, most: int = 3) -> Column:
    content = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.slice(F.filter(terms, lambda t: F.contains(content, F.lower(t))), 1, most)


def mode(prompt: Column) -> Column:
    """executing, reflecting, exploring or deepening; socializing for an empty prompt."""
    low = F.btrim(F.lower(prompt), F.lit(" \t\r\n"))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    one = lambda c: F.when(c, 1).otherwise(0)
    has = lambda x, p: x.rlike(ascii_boundaries(p))
    verbs = F.size(_found(low, VERBS))
    tasks = 2 * one(has(F.get(words, F.lit(0)), VERBS)) + one(verbs >= 1) + one(verbs >= 2) + one(has(low, TASKS))
    judging = has(low, JUDGING)
    judged = F.least(F.size(_found(low, JUDGED)), F.lit(3)) + one(judging)
    asked = 2 * one(low.rlike(ASKING)) + one(has(low, ASKED)) + one(low.contains("?"))
    return (
        F.when(F.size(words) == 0, "socializing").when((tasks >= 2) | ((tasks >= 1) & (judged == 0) & (asked == 0)), "executing").when((judged >= 2) | ((judged >= 1) & judging), "reflecting")
        .when(asked >= 1, "exploring").when((F.size(words) <= SHORT) & (tasks == 0) & (judged == 0), "deepening").otherwise("exploring")
    )


def asks_for_recent(prompt: Column) -> Column:
    return F.coalesce(_any(F.lower(prompt), RECENT), F.lit(False))


def type_factors(prompt: Column) -> Column:
    """A map from content type to the factor that a prompt's words give it."""
    low = F.lower(prompt)
    entries = F.array(*[F.when(_any(low, words), F.struct(F.lit(kind).alias("type"), F.lit(factor).alias("factor"))) for (kind, factor), words in TYPES.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def asks_for_stale(prompt: Column) -> Column:
    """Whether stale notes are asked for, so that they aren't marked down."""
    return F.coalesce(_any(F.lower(prompt), STALE), F.lit(False))


def metadata_hints(prompt: Column) -> Column:
    """struct(trust_state, about_metadata, low_confidence, provenance). The longest word for a state wins; doubt without a state means stale notes."""
    low = F.lower(prompt)
    state = F.lit(None).cast("string")
    for word in sorted(STATES, key=len):
        state = F.when(low.contains(word), STATES[word]).otherwise(state)
    doubt, origin = F.coalesce(_any(low, DOUBT), F.lit(False)), F.coalesce(_any(low, ORIGIN), F.lit(False))
    return F.struct(
        F.when(state.isNull() & doubt, "stale").otherwise(state).alias("trust_state"), (state.isNotNull() | doubt | origin).alias("about_metadata"), doubt.alias("low_confidence"), origin.alias("provenance")
    )


def title_parts(title: Column) -> Column:
    """A title's words, cut at spaces and common signs."""
    return F.filter(F.split(F.lower(title), "[ \\-_(),./:\u2014&]+"), lambda w: w != "")
