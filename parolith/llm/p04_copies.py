"""Problem 4: records that differ in white space, letter case, punctuation or field order alone.

Progressive partition refinement. Level 1 groups all records by invariants that need no parsing: the length left when
everything but letters and digits is stripped, and a letter histogram over both fields together (so field order does not
matter). Only classes with several members go on to level 2, where the exact key is computed: the unordered pair of the
fields' word sequences. Level 1 is pure JVM work, and the exact key's Python sees the surviving records alone.

A class that holds a third of all rows is counted map-side at both levels and its join is left to AQE's skew split; no
group is ever collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import cut, not_blank, quoted, with_id
from parolith.llm.textforms import fold, is_case, words

#: Letters counted together in level 1: a common one of each script, in the later groups of Latin alone.
HISTOGRAM = ("eаارนの不", "oеلकรい人", "rиمनกに一", "uнنमงは有", "d", "m", "c", "p")
#: Letters and digits of the stripped length: of the scripts with capitals the plain ones, of the others the base letters.
_PLAIN = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x410, 0x44F), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3094), (0x30A1, 0x30FA))


@lru_cache(maxsize=1)
def countable() -> frozenset[str]:
    """The plain letters and digits, and those of the histogram, that level 1 may count.

    A letter is left out if a character other than itself and its plain capital folds to it or to several letters with it among
    them (sharp s, ligatures, the Kelvin sign, dotless i): such a character and what it folds to would be counted differently.
    """
    plain = {chr(c) for a, b in _PLAIN for c in range(a, b + 1)} | set("".join(HISTOGRAM))
    bad = set()
    for c in map(chr, range(0x30000)):
        folded = fold(c)
        if folded != c and not (c in plain and len(folded) == 1 and c.lower() == folded):
            bad |= set(folded)
    return frozenset(c for c in plain if fold(c) not in bad)


def cheap_invariants(a: Column, b: Column) -> Column:
    """One number that copies share: stripped length and letter histogram of both fields together.

    Each count is a sum over single characters that is equal for a character and for what ``fold`` makes of it, so records
    with equal exact keys have equal invariants. Letters are counted in either case by what is left without them.
    """
    both = F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))
    known = countable()
    whole = F.length(both)
    counts = [whole - F.length(F.translate(both, "".join(sorted(known)), ""))]
    for group in HISTOGRAM:
        rest = both
        for ch in sorted({x for c in group if c in known for x in (c, c.upper())}):
            rest = F.replace(rest, F.lit(ch), F.lit(""))
        counts.append(whole - F.length(rest))
    return F.xxhash64(*counts)


def exact_key(a: str | None, b: str | None) -> bytes:
    """The unordered pair of word sequences; null equals blank."""
    x, y = sorted((" ".join(words(a)), " ".join(words(b))))
    return hashlib.blake2b(f"{x}\n{y}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def copy_keys(df: DataFrame, id_col: str, a: str, b: str, skip_form_cases: bool = True) -> DataFrame:
    """(id, key) of the records that share their cheap invariants with another one.

    Records whose first field is null or blank take no part, nor, if asked, those with a character in an unusual form in it.
    """
    rows = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(a).cast("string").alias("a"), quoted(b).cast("string").alias("b")).where(not_blank("a"))
    rows = rows.withColumn("inv", cheap_invariants(F.col("a"), F.col("b")))
    several = rows.groupBy("inv").agg(F.count("*").alias("n")).where("n > 1").select("inv")
    survivors = rows.join(several, "inv").select("id", "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [not (skip_form_cases and is_case(t)) for t in p["a"]]
            p = p[keep]
            yield pd.DataFrame({"id": p["id"], "key": pd.Series([exact_key(x, y) for x, y in zip(p["a"], p["b"])], dtype="object", index=p.index)})

    return survivors.mapInPandas(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType())]))


def find_copies(df: DataFrame, id_col: str, a: str, b: str, skip_form_cases: bool = True) -> tuple[DataFrame, DataFrame]:
    """(copies, groups): (first_id, id) of every copy but the first of its group, and (first_id, n_copies) of every group.

    The group's first is its least id. Null and blank second fields are equal; records of empty tables, or without a
    copy, give no row. Word order within a field counts; other columns do not.
    """
    keyed = cut(copy_keys(df, id_col, a, b, skip_form_cases))
    groups = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    copies = keyed.join(groups, "key").where("id > first_id").select("first_id", "id")
    return copies, groups.select("first_id", "n_copies")
