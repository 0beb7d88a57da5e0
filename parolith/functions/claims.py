"""Canonical claims and the reduced wording that is compared: rule tables, rendered for Spark and for the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parolith.functions.patterns import S, W
from parolith.functions.text import trim_all

#: Fixed values: (what a claim looks like, what it becomes), in this order; the first that fits is taken. \1 and \2 are the captured parts.
REWRITES = (
    (r"(?:it'?s )?better (?:to )?(.+?) than (?:to )?(.+?)", r"Better \1 than \2."),
    (r"(.+?) is better than (.+?)", r"Better \1 than \2."),
    (r"prefer (.+?) (?:over|to) (.+?)", r"Better \1 than \2."),
    (r"(?:you should )?(?:never|don'?t|do not|cannot|can'?t|avoid) (.+?)", r"Avoid \1."),
    (r"(?:it'?s )?(?:bad|wrong|dangerous) to (.+?)", r"Avoid \1."),
    (r"(?:when|if) (.+?), (?:then )?(.+?)", r"If \1, then \2."),
    (r"where (?:there'?s|you (?:have|find)) (.+?), (?:there'?s|you (?:have|find)) (.+?)", r"If there is \1, there is \2."),
    (r"(?:the )?early (.+?) (?:gets?|catches?) (?:the )?(.+?)", r"Early action brings \2."),
    (r"(?:practice|repetition) makes? (?:perfect|improvement)", "Practice improves skill."),
    (r"time (?:is|equals?) (?:money|wealth|value)", "Time has value."),
    (r"(?:many|multiple|several) hands (?:make|create) (?:light work|easy work)", "Cooperation reduces effort."),
    (r"(?:together|unity) (?:we|is) (?:stand|strength)(?:, (?:divided|apart) (?:we )?fall)?", "Unity creates strength."),
    (r"too (?:many|much) (.+?) (?:spoils?|ruins?) (?:the )?(.+?)", r"Excess of \1 harms \2."),
    (r"(?:all work|only work) and no play makes? (.+?) (?:a )?(?:dull|boring) (?:boy|person)", "Balance work and rest."),
    (r"(?:haste|rushing|hurrying) (?:makes|creates|causes) (?:waste|mistakes|errors)", "Haste causes problems."),
    (r"(?:slow and )?steady wins (?:the )?race", "Consistency beats speed."),
    (r"(?:good things|patience) (?:comes?|rewards) (?:to )?(?:those who|people who) wait", "Patience brings rewards."),
)
#: Introductions and endings that add nothing.
INTRODUCTION = rf"(?i)^(?:old saying:|proverb:|they say:?|it is said:?)[{S}]*"
ATTRIBUTION = rf"(?i)[{S}]*- [{W}]+ (?:proverb|saying)\.?$"
#: Words with one meaning for the comparison; the first of each class stands for all, articles vanish.
ARTICLES = ("a", "an", "the")
WORD_CLASSES = {
    "be": ("is", "are", "was", "were", "be", "being"),
    "will": ("will", "shall", "would", "should", "could", "can", "may", "might"),
    "do": ("do", "does", "did", "done"),
    "have": ("have", "has", "had"),
    "person": ("person", "people", "man", "men", "woman", "women", "individual", "one"),
    "home": ("home", "house", "dwelling"),
    "wealth": ("money", "wealth", "riches", "fortune", "gold"),
    "friend": ("friend", "buddy", "companion", "ally"),
    "enemy": ("enemy", "foe", "opponent", "rival"),
    "work": ("work", "labor", "effort", "toil", "task"),
    "time": ("time", "moment", "hour", "day"),
    "speak": ("speak", "talk", "say", "tell", "utter"),
    "good": ("good", "fine", "excellent", "great", "wonderful"),
    "bad": ("bad", "terrible", "awful", "horrible", "poor"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; else generated code grows with every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(shape: str) -> str:
    return rf"(?i)^{shape}\.?$"


def canonicalise(c: Column) -> Column:
    """A saying as a canonical claim. The parts run in a fixed order, and rewriting is not idempotent."""
    t = F.regexp_replace(trim_all(F.coalesce(c, F.lit(""))), '^"+|"+$', "")
    t = F.regexp_replace(t, rf"[{S}]+", " ")
    t = F.translate(F.translate(t, "`", '"'), "–—", "--")
    t = F.regexp_replace(F.regexp_replace(t, INTRODUCTION, ""), ATTRIBUTION, "")
    return let(t, lambda x: let(trim_all(_rewritten(x)), _terminated))


def _rewritten(t: Column) -> Column:
    made = t
    for shape, becomes in reversed(REWRITES):
        made = F.when(t.rlike(_whole(shape)), F.regexp_replace(t, _whole(shape), becomes.replace("\\", "$"))).otherwise(made)
    return made


def _terminated(t: Column) -> Column:
    return F.when((t == "") | t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def canonical_sql(column: str) -> str:
    """The same in the checking SQL."""
    t = f"regexp_replace(regexp_replace(coalesce({column}, ''), '^[{S}]+|[{S}]+$', '', 'g'), '^\"+|\"+$', '', 'g')"
    t = f"replace(translate(regexp_replace({t}, '[{S}]+', ' ', 'g'), '–—', '--'), '`', '\"')"
    t = f"regexp_replace(regexp_replace({t}, '{INTRODUCTION}', ''), '{_quote(ATTRIBUTION)}', '')"
    cases = " ".join(f"WHEN regexp_matches(t0, '{_quote(_whole(s))}') THEN regexp_replace(t0, '{_quote(_whole(s))}', '{b}')" for s, b in REWRITES)
    done = f"(SELECT regexp_replace(CASE {cases} ELSE t0 END, '^[{S}]+|[{S}]+$', '', 'g') AS d FROM (SELECT {t} AS t0))"
    return f"(SELECT CASE WHEN d = '' OR regexp_matches(d, '[.!?]$') THEN d ELSE d || '.' END FROM {done})"


def _quote(pattern: str) -> str:
    return pattern.replace("'", "''")


def reduce_wording(c: Column) -> Column:
    """Lower case, without articles, each word as the first of its class, without marks but . ! ?"""
    tokens = F.regexp_extract_all(F.lower(trim_all(F.coalesce(c, F.lit("")))), F.lit(rf"[{W}]+|[^{W}]+"), F.lit(0))

    def swap(t: Column) -> Column:
        made = F.when(t.isin(*ARTICLES), F.lit(""))
        for word, members in WORD_CLASSES.items():
            made = made.when(t.isin(*members), F.lit(word))
        return made.otherwise(t)

    joined = F.array_join(F.transform(tokens, swap), "")
    return trim_all(F.regexp_replace(F.regexp_replace(joined, rf"[^{W}{S}.!?]", " "), rf"[{S}]+", " "))


def reduced_sql(column: str) -> str:
    whens = " ".join(f"WHEN x IN ({', '.join(repr(m) for m in ms)}) THEN '{w}'" for w, ms in WORD_CLASSES.items())
    articles = ", ".join(repr(a) for a in ARTICLES)
    tokens = f"regexp_extract_all(lower(regexp_replace(coalesce({column}, ''), '^[{S}]+|[{S}]+$', '', 'g')), '[{W}]+|[^{W}]+')"
    joined = f"coalesce(array_to_string(list_transform({tokens}, lambda x: CASE WHEN x IN ({articles}) THEN '' {whens} ELSE x END), ''), '')"
    return f"regexp_replace(regexp_replace(regexp_replace({joined}, '[^{W}{S}.!?]', ' ', 'g'), '[{S}]+', ' ', 'g'), '^[{S}]+|[{S}]+$', '', 'g')"
