"""Building the clean table of sayings: union, cleaning, first of each (people, basis), quality rank, source selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions import text as X
from parolith.schemas import SAYINGS, conform


#: The peoples offered first.
MAJOR_PEOPLES = ("English", "Chinese", "Spanish", "Arabic", "Hindi", "French", "Russian", "Japanese")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by the order column: an aggregate with partial sums, so a key with very many rows sends few."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return best.select(*[F.col(f"_first.{c}") if c in rest else F.col(c) for c in df.columns])


def with_basis(df: DataFrame) -> DataFrame:
    """Normalised saying and equivalent, and their basis: the equivalent unless blank, else the saying."""
    df = df.withColumns({"saying": X.normalise_text(F.col("saying")), "english_equivalent": X.normalise_text(F.col("english_equivalent"))})
    return df.withColumn("basis", F.when(F.col("english_equivalent") != "", F.col("english_equivalent")).otherwise(F.col("saying")))


def clean_sayings(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows worth keeping, the first of each (people, basis); a blank original is filled from the saying. The input stays as it is."""
    missing = {f.name: F.lit("") for f in SAYINGS if f.name not in df.columns}
    kept = with_basis(df.withColumns(missing) if missing else df).where(X.keep_basis(F.col("basis")))
    kept = kept.withColumn("original", F.when(X.trim_all(F.coalesce("original", F.lit(""))) == "", F.col("saying")).otherwise(F.col("original")))
    return keep_first(kept, ["people", "basis"], order)


def rank_quality(clean: DataFrame, order: str = "row_id") -> DataFrame:
    scored = clean.withColumn("quality_score", X.quality_score(F.col("basis")))
    return scored.orderBy(F.desc("quality_score"), "people", order)


def union_sayings(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of frames that may lack columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_and_clean(frames: Sequence[DataFrame], order: str = "row_id", filter_rows: bool = False, classify: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw, clean and ranked); the row filter is off unless asked for."""
    raw = union_sayings(frames)
    clean = clean_sayings(raw, order)
    if filter_rows:
        clean = clean.where(X.filter_cascade(F.col("basis"), classify))
    return raw, rank_quality(clean, order)


def select_sources(sources: DataFrame, people: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """An empty or absent list selects all."""
    if people:
        sources = sources.where(F.col("people").isin(*people))
    if types:
        sources = sources.where(F.coalesce("type", F.lit("wikiquote")).isin(*types))
    return sources


def default_people(sources: DataFrame, most: int = 5, major: Sequence[str] = MAJOR_PEOPLES) -> DataFrame:
    """(people, place): of the peoples by name, major ones up to half of the number wanted, then others until it is reached."""
    named = sources.select("people").where("people is not null").distinct().withColumn("is_major", F.col("people").isin(*major))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("is_major").orderBy("people")))  # a row per people: a catalogue's list, not data
    first = ranked.where(F.col("is_major") & (F.col("r") <= most // 2))
    room = F.lit(most) - F.count("*")
    rest = ranked.where("not is_major").join(F.broadcast(first.agg(room.alias("room"))), F.col("r") <= F.col("room"))
    both = first.select("people", F.lit(0).alias("part"), "r").union(rest.select("people", F.lit(1), "r"))
    return both.select("people", F.row_number().over(Window.partitionBy().orderBy("part", "r")).cast("int").alias("place"))


def as_saying_rows(items: DataFrame, kind: Column, accessed: str, item: str = "item") -> DataFrame:
    """Extracted items as rows of the sayings table; the access date is given, never taken from the clock."""
    return conform(
        items.select(
            "people", F.col(item).alias("original"), F.col(item).alias("saying"), F.lit("").alias("english_equivalent"),
            F.concat(kind, F.lit(": "), F.col("people")).alias("source_title"), F.col("url").alias("source_url"), F.lit(accessed).alias("accessed"),
        ),
        SAYINGS,
    )
