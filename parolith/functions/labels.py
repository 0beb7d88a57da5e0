"""Lookups and labels: language families, themes, ordinal scales and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The family under which a people's sayings are counted; any other is "Other".
FAMILIES = {
    "English": "Germanic", "German": "Germanic", "Dutch": "Germanic", "Swedish": "Germanic", "Norwegian": "Germanic",
    "Romanian": "Romance", "Italian": "Romance", "Spanish": "Romance", "French": "Romance", "Portuguese": "Romance",
    "Russian": "Slavic", "Polish": "Slavic", "Czech": "Slavic", "Ukrainian": "Slavic", "Bulgarian": "Slavic",
    "Chinese": "Sino-Tibetan", "Japanese": "Japonic", "Korean": "Koreanic", "Thai": "Tai-Kadai",
    "Arabic": "Afro-Asiatic", "Hebrew": "Afro-Asiatic", "Turkish": "Turkic", "Finnish": "Uralic",
    "Hindi": "Indo-Iranian", "Persian": "Indo-Iranian", "Bengali": "Indo-Iranian", "Urdu": "Indo-Iranian",
    "Indonesian": "Austronesian", "Malay": "Austronesian", "Filipino": "Austronesian", "Vietnamese": "Austro-Asiatic",
}
#: Themes of the report in order, with the fragments that tell them.
REPORT_THEMES = (
    ("Cooperation / Social Support", ("cooperat", "together", "friend", "help", "union", "many hands", "community", "neighbor", "neighbour")),
    ("Prudence / Risk & Uncertainty", ("avoid", "never", "caution", "careful", "haste", "risk", "danger", "guard", "beware", "look before", "prudence", "slow", "steady")),
    ("Effort / Time / Persistence", ("work", "practice", "effort", "time", "early", "persever", "patience", "diligence", "delay")),
    ("Trust / Honesty / Deception", ("honest", "truth", "deception", "lie", "false", "trust", "cheat", "thief", "wolf", "fox")),
    ("Family / Kinship / Obligation", ("family", "blood", "kin", "father", "mother", "son", "daughter", "home", "house")),
    ("Fate / Fortune / Opportunity", ("fortune", "luck", "opportunity", "chance", "bold", "fate", "destiny", "star")),
    ("Knowledge / Speech / Silence", ("word", "speak", "silence", "listen", "tongue", "knowledge", "book", "learn", "wisdom")),
)
#: Themes of the diagnostics in order.
DIAGNOSTIC_THEMES = (
    ("Cooperation", ("friend", "together", "help", "cooperat", "many hands")),
    ("Caution", ("avoid", "never", "careful", "haste", "danger")),
    ("Honesty", ("honest", "truth", "lie", "trust")),
    ("Timing", ("time", "early", "late", "patience")),
    ("Effort", ("work", "practice", "effort")),
)
#: What ratings in words are worth, and what an unknown word is worth.
COHERENCE = ({"Yes, clearly": 5, "Mostly yes": 4, "Somewhat": 3, "Not really": 2, "No": 1}, 3)
QUALITY = ({"Excellent": 4, "Good": 3, "Fair": 2, "Poor": 1}, 2)


def _members() -> dict[str, list[str]]:
    made: dict[str, list[str]] = {}
    for people, family in FAMILIES.items():
        made.setdefault(family, []).append(people)
    return made


def family_of(people: Column) -> Column:
    made = F.lit("Other")
    for family, members in _members().items():
        made = F.when(people.isin(*members), F.lit(family)).otherwise(made)
    return made


def family_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(repr(m) for m in ms)}) THEN '{f}'" for f, ms in _members().items()) + " ELSE 'Other' END"


def theme_of(claim: Column, themes=REPORT_THEMES) -> Column:
    """The first theme with a fragment in the claim."""
    low = F.lower(F.coalesce(claim, F.lit("")))
    made = F.lit("Other")
    for name, keys in reversed(themes):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        made = F.when(hit, F.lit(name)).otherwise(made)
    return made


def theme_sql(column: str, themes=REPORT_THEMES) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({column}, '')), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in themes) + " ELSE 'Other' END"


def on_scale(word: Column, scale: tuple[dict[str, int], int]) -> Column:
    values, unknown = scale
    made = F.lit(unknown)
    for name, value in values.items():
        made = F.when(word == name, F.lit(value)).otherwise(made)
    return made


def scale_sql(column: str, scale: tuple[dict[str, int], int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in scale[0].items()) + f" ELSE {scale[1]} END"


def low_med_high(value: Column) -> Column:
    """1, 2, 3, or null."""
    return F.when(value == "Low", 1).when(value == "Med", 2).when(value == "High", 3)


def trust_band(score: Column) -> Column:
    return F.when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")
