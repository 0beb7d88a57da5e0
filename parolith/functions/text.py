"""Column expressions on single texts: cleaning, predicates, word counts and row scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parolith.functions.patterns import W, S, whole_words

#: Words that make a text look like a saying to the cleaner.
CLEANER_CUES = (
    "is", "are", "was", "were", "be", "have", "do", "does", "did", "shall", "will", "can", "may", "should", "must", "let", "make", "take", "give",
    "go", "come", "keep", "put", "never", "don'?t", "avoid", "if", "when", "where", "who", "what", "speak", "say", "think", "know", "trust", "bite",
    "bark", "save", "waste", "pay", "buy", "sell", "wait", "hasten", "repent", "many", "too",
)
#: Words that make a text look like a saying to the row filter, anywhere and as the first word.
FILTER_CUES = (
    "if", "then", "never", "always", "should", "must", "avoid", "prefer", "time", "friend", "truth", "honesty", "fortune", "blood", "work", "early",
    "slow", "patience", "many", "too",
)
FILTER_OPENERS = (
    "if", "where", "better", "many", "too", "time", "practice", "honesty", "fortune", "blood", "early", "slow", "truth", "silence", "friend", "work",
)
#: Words that raise a row's quality score.
SCORE_CUES = (
    "if", "then", "never", "always", "should", "must", "avoid", "prefer", "time", "practice", "friend", "truth", "honesty", "fortune", "blood", "work",
)
#: Phrases of page furniture, for the cleaner, for the extractors, and for the row filter.
FURNITURE = ("ISBN", "ISSN", "Retrieved from", "Privacy Policy", "Terms of Use", "Creative Commons", "What links here")
NAVIGATION = ("see also", "external links", "references", "navigation", "category")
FILTER_PHRASES = (
    "Text is available under the Creative Commons", "Terms of Use", "Privacy Policy", "What links here", "Navigation menu", "External links", "Retrieved from",
    "Category:", "This page was last edited", "Infobase Publishing", r"DeProverbio\.com", "WorldCat",
)

SENTENCE_MARK = "[.!?;:]"
LABEL = rf"(?i)(^|[^{W}])english[{S}]*equivalent[{S}]*:[{S}]*"
CATEGORY_TRAP = rf"(?i)(?:^|[^{W}])Category:[{W}]"
NAME_FURNITURE = whole_words(FURNITURE)
NAME_TOKEN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}']+"
CAPITAL_START = r"^[A-Z\x{c0}-\x{d6}\x{d8}-\x{de}]"
BIBLIOGRAPHIC = rf"(?i)(?:^|[^{W}])(?:(?:ISBN|ISSN)(?:$|[^{W}])|p\.[{S}]*[0-9]+(?:$|[^{W}]))"
NAVIGATIONAL = whole_words([*NAVIGATION]) + "|(?i)^edit$|(?i)^jump to(?:$|[^" + W + "])"
FILTER_BAD = rf"(?i){'|'.join(FILTER_PHRASES)}|(?i)References(?:$|[^{W}])|(?i)(?:^|[^{W}])ISBN:?[{S}]*[0-9]"
CITATION_YEAR = rf"[A-Z][a-z]+(?:[{S}]+[A-Z][a-z]+){{0,3}}[{S}]*\([0-9]{{4}}\)\."
CITATION_NEXT = rf"\.[{S}]*[A-Z]"


def trim_all(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, rf"^[{S}]+|[{S}]+$", "")


def normalise_text(c: Column) -> Column:
    """Null as blank, without the label "english equivalent:", white space collapsed."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), LABEL, "$1")
    return trim_all(F.regexp_replace(bare, rf"[{S}]+", " "))


def word_count(c: Column) -> Column:
    """Words between runs of white space; none in a blank text."""
    t = trim_all(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"[{S}]+")))


def first_filled(preferred: Column, other: Column) -> Column:
    """The preferred text unless it is null or blank."""
    return F.when(trim_all(F.coalesce(preferred, F.lit(""))) != "", preferred).otherwise(other)


def has_sentence_mark(c: Column) -> Column:
    return c.rlike(SENTENCE_MARK)


def name_like(c: Column) -> Column:
    """Page furniture, or one to three Latin words that all begin with a capital."""
    tokens = F.regexp_extract_all(c, F.lit(NAME_TOKEN), F.lit(0))
    named = F.size(tokens).between(1, 3) & F.forall(tokens, lambda t: t.rlike(CAPITAL_START))
    return c.rlike(NAME_FURNITURE) | c.rlike(CATEGORY_TRAP) | named


def cleaner_cues(c: Column) -> Column:
    return has_sentence_mark(c) | c.rlike(whole_words(CLEANER_CUES))


def navigational(c: Column) -> Column:
    return c.rlike(NAVIGATIONAL)


def bibliographic(c: Column) -> Column:
    """Book numbers and page references."""
    return c.rlike(BIBLIOGRAPHIC)


def keep_basis(c: Column) -> Column:
    """The cleaner's verdict: six characters, no bare name, no navigation, no reference."""
    return (F.char_length(c) >= 6) & ~(name_like(c) & ~cleaner_cues(c)) & ~navigational(c) & ~bibliographic(c)


def filter_bibliography(c: Column) -> Column:
    """The row filter's idea of bibliography: blank, furniture, citations, or more than forty words without a mark."""
    t = trim_all(F.coalesce(c, F.lit("")))
    cited = t.rlike(CITATION_YEAR) & t.rlike(CITATION_NEXT)
    return (t == "") | bibliographic(t) | t.rlike(FILTER_BAD) | cited | ((word_count(t) > 40) & ~has_sentence_mark(t))


def filter_cues(c: Column) -> Column:
    opener = rf"(?i)^(?:{'|'.join(FILTER_OPENERS)})(?:$|[^{W}])"
    return has_sentence_mark(c) | c.rlike(whole_words(FILTER_CUES)) | c.rlike(opener)


def filter_cascade(c: Column, classify: Column | None = None) -> Column:
    """Bibliography is out, a text of at most forty words with cues is in; the rest goes to the classifier, or to the rules again."""
    t = F.coalesce(c, F.lit(""))
    rest = classify if classify is not None else (~filter_bibliography(t) & filter_cues(t))
    return F.when(filter_bibliography(t), F.lit(False)).when(filter_cues(t) & (word_count(t) <= 40), F.lit(True)).otherwise(rest)


def quality_score(basis: Column) -> Column:
    """0 to 6: a sentence mark 2, a cue word 2, five words 1, twenty characters 1."""
    points: Iterable[tuple[Column, int]] = ((has_sentence_mark(basis), 2), (basis.rlike(whole_words(SCORE_CUES)), 2), (word_count(basis) >= 5, 1), (F.char_length(basis) >= 20, 1))
    total = F.lit(0)
    for test, n in points:
        total = total + F.when(test, n).otherwise(0)
    return total.cast("int")
