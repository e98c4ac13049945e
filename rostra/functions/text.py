"""Text functions as Column expressions; none of them needs a Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostra import constants as K

WORD_PATTERN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str, limit: int | None = None) -> Column:
    """Lower-case runs between blanks, tabs, line ends and form feeds; the first ``limit`` of them."""
    found = F.filter(F.split(F.lower(col(c)), r"[ \t\n\r\f]+"), lambda x: x != "")
    return F.slice(found, 1, limit) if limit is not None else found


def analyze(c: Column | str) -> Column:
    """Words of letters and digits in lower case; apostrophes inside a word stay."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_PATTERN), F.lit(0))


def analyzed_words(text: str) -> list[str]:
    """The same words of a driver-side string."""
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text.lower())


def token_count(c: Column | str, term: str, limit: int | None = K.TOKEN_LIMIT) -> Column:
    """Tokens equal to the term among the first ``limit``."""
    return F.size(F.filter(tokens(c, limit), lambda x: x == term.strip().lower()))


def _may_have(c: Column | str, words: Sequence[str]) -> Column:
    """Whether the text holds all words as strings: a cheap test that spares most texts the analysis."""
    low = F.lower(col(c))
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in dict.fromkeys(words)])


def has_term(c: Column | str, term: str) -> Column:
    """Whether the analyzed text has the term as a word; no text has a term of several words."""
    word = term.strip().lower()
    return _may_have(c, [word]) & F.array_contains(analyze(c), word)


def has_phrase(c: Column | str, phrase: str) -> Column:
    """Whether the words of the phrase stand together in the analyzed text."""
    words = analyzed_words(phrase)
    if not words:
        return F.lit(False)
    padded = F.concat(F.lit(" "), F.array_join(analyze(c), " "), F.lit(" "))
    return _may_have(c, words) & F.contains(padded, F.lit(f" {' '.join(words)} "))


def phrase_count(c: Column | str, phrase: str, analyzed: Column | None = None) -> Column:
    """Places where the words of the phrase stand together; ``analyzed`` gives the text's words where they are known."""
    words = analyzed_words(phrase)
    found = analyze(c) if analyzed is None else analyzed
    if len(words) == 1:
        return F.size(F.filter(found, lambda x: x == words[0]))
    # doubled separators keep neighbouring matches apart
    padded = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    whole = " " + "  ".join(words) + " "
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(whole), F.lit("")))) / len(whole)).cast("int")


def mentions(c: Column | str, phrase: str) -> Column:
    """Non-overlapping occurrences of the phrase as a string; an empty one occurs between all characters."""
    t, q = F.lower(col(c)), phrase.lower()
    if not q:
        return (F.length(t) + 1).cast("int")
    return ((F.length(t) - F.length(F.replace(t, F.lit(q), F.lit("")))) / len(q)).cast("int")


def snippet(c: Column | str, phrase: str, before: int = 100, after: int = 200) -> Column:
    """The text from ``before`` characters before the first match to ``after`` after its start; null if it starts the text or is absent."""
    t = col(c)
    p = F.instr(F.lower(t), phrase.lower())
    start = F.greatest(F.lit(0), p - 1 - before)
    end = F.least(F.length(t), p - 1 + after)
    return F.when(p > 1, F.substring(t, start + 1, end - start))


def human_date(c: Column | str) -> Column:
    return F.date_format(col(c), "MMM dd, yyyy")


def title(c: Column | str) -> Column:
    """Each run of letters with one capital, whatever stands between."""
    runs = F.regexp_extract_all(col(c), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    # where a letter's capital is several letters, only the first of them is one
    head = lambda x: F.upper(F.substring(x, 1, 1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.substring(head(x), 1, 1), F.lower(F.concat(F.substring(head(x), 2, 8), F.substring(x, 2, 1 << 30))))), "")


def slug(c: Column | str) -> Column:
    """Lower-case words joined by hyphens."""
    return F.array_join(F.filter(F.split(F.lower(col(c)), r"\s+"), lambda x: x != ""), "-")


def _class(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "[]\\^-&" else m for m in marks) + "]+"


def remove_punct(c: Column | str, marks: str = K.MARKS, leading: str | None = None) -> Column:
    """Hyphens become blanks, double blanks single; then leading marks and all marks go."""
    t = strip(F.regexp_replace(F.regexp_replace(col(c), "-", " "), "  ", " "))
    if leading:
        t = F.regexp_replace(t, "^" + _class(leading), "")
    return F.regexp_replace(t, _class(marks), "")


def camel_case(c: Column | str, force: bool = False, threshold: int = K.SHORT_WORD) -> Column:
    """Title case for each word; forced, short single words stay; not forced, words in capitals stay."""
    t = col(c)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    if force:
        several = F.array_join(F.transform(words, title), " ")
        return F.when(F.size(words) > 1, several).otherwise(F.when(F.length(t) > threshold, title(t)).otherwise(t))
    return F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(title(w))), " ")


def clean_entity(c: Column | str) -> Column:
    """An entity's text without marks, in forced camel case; null if it is on the blacklist."""
    def kept(t: Column) -> Column:
        # the first of the tails is asked for with one more blank than it has: historical behaviour
        cut = F.regexp_replace(t, " " + "|".join(f"{tail}$" for tail in K.ENTITY_TAILS), "")
        return F.when(~title(t).isin(K.ENTITY_BLACKLIST), cut)

    # each step is bound once; nested, the patterns would be matched many times over
    return let(remove_punct(c, leading=K.LEADING_MARKS), lambda p: let(camel_case(p, force=True), kept))


def entity_kept(surface: Column | str, label: Column | str, numeric: Sequence[str] = K.NUMERIC_TYPES) -> Column:
    """Entities of more than one character and of no numeric type."""
    return col(surface).isNotNull() & (F.length(col(surface)) > 1) & ~F.coalesce(col(label), F.lit("")).isin(list(numeric))


def chunk_kept(text: Column | str, lemma: Column | str) -> Column:
    """Noun chunks without a blacklisted substring and without a pronoun."""
    low = F.lower(col(text))
    bad = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in K.CHUNK_BLACKLIST])
    return ~(bad | F.contains(col(lemma), F.lit(K.PRONOUN_LEMMA)))


def without_determiner(c: Column | str) -> Column:
    """A noun chunk without the determiner that begins it."""
    return F.regexp_replace(col(c), f"(?i)^(?:{'|'.join(K.DETERMINERS)})\\s+(?=\\S)", "")


def clean_chunk(c: Column | str) -> Column:
    return title(remove_punct(c))


def without_trailing_tags(words: Column, verb: bool = True, adposition: bool = True, conjunction: bool = True, determiner: bool = True, possessive: bool = True) -> Column:
    """An array of (text, tag) without its trailing verb, adposition, conjunction, determiner and possessive, in that order; null if nothing is left."""
    # each step binds its array once; nested conditions would repeat it many times over
    step = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))

    def drop(a: Column, n: int, when: Column) -> Column:
        return F.when(when, F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - n))).otherwise(a)

    def tag(a: Column, k: int) -> Column:
        return F.coalesce(F.try_element_at(a, F.lit(k))["tag"], F.lit(""))

    def without(name: str, a: Column) -> Column:
        return drop(a, 1, tag(a, -1) == name)

    w = words
    if verb:
        w = step(w, lambda a: drop(a, 1, tag(a, -1).isin(K.VERB_TAGS)))
        w = step(w, lambda a: drop(a, 2, (tag(a, -1) == "RB") & tag(a, -2).isin(K.VERB_TAGS)))
    for on, name in ((adposition, "IN"), (conjunction, "CC"), (determiner, "DT"), (possessive, "POS")):
        if on:
            w = step(w, partial(without, name))
    return step(w, lambda a: F.when(F.size(a) > 0, a))


# The patterns and the order of the clean-up steps, and the heading's letters.
#: The order of clean-up steps matters: (pattern, replacement, strip afterwards).
CLEANUP = [
    (r"(?U)E\s?X\s?T\s?E\s?N\s?S\s?I\s?O\s?N\s+O\s?F\s+R\s?E\s?M\s?A\s?R\s?K\s?S\n+", "", False),
    (r"HON\.", "HON", False),
    (r"\n{2,}", ". ", False),
    (r"_{3,}", "\n", False),
    (r"<[^<]+?>", "", False),
    (r"\n{3,}", ". ", True),
    (r"\n", " ", True),
    (r" {3,}", " ", True),
    (r"(?U)\s{2,}", " ", True),
    (r"\.{2,}", ".", True),
    (r"[. ]{2,}", ". ", True),
    (r"[. ]{2,}", ". ", True),
    (r"\. of", " of", False),
    (r"\. in", " in", False),
]
HEADING = r"[A-Z!\"#$%&'()*+,\-./:;<=>?@\[\]\^_`{|}~ ]{10,}"


def from_heading(c: Column | str) -> Column:
    """The text from its first run of ten capitals and marks on; null if it has none."""
    t = col(c)
    at = F.regexp_instr(t, F.lit(HEADING))
    return F.when(at > 0, F.substring(t, at, F.length(t)))


def clean(c: Column | str, heading: bool = True) -> Column:
    """All clean-up steps in order; with ``heading`` only from the first heading on."""
    t = from_heading(c) if heading else col(c)
    for pattern, to, ends in CLEANUP:
        t = F.regexp_replace(t, pattern, to)
        t = strip(t) if ends else t
    return t


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^<]+?>", "")


def short_name(c: Column | str) -> Column:
    """A speaker's heading without the state."""
    return F.regexp_replace(col(c), " of .*$", "")
