"""From rows to claims, and from assigned claims to scored clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions import text as X
from parolith.functions.claims import canonicalise, reduce_wording
from parolith.functions.labels import family_of
from parolith.operators.clean import keep_first
from parolith.session import cut

#: Openers that raise a claim's score wherever they stand.
CLAIM_OPENERS = ("if ", "when ", "better ", "avoid ", "never ")


def prepare_claims(df: DataFrame, order: str = "row_id", least: int = 10, dedup: bool = True) -> DataFrame:
    """(order, people, saying, basis, processed, claim): the first row of each claim of at least ten characters."""
    if "english_equivalent" not in df.columns:
        df = df.withColumn("english_equivalent", F.lit(""))
    rows = df.select(order, "people", "saying", "english_equivalent").na.drop(subset=["people", "saying"])
    rows = rows.withColumn("basis", X.first_filled(F.col("english_equivalent"), F.col("saying"))).where(X.trim_all(F.col("basis")) != "")
    rows = rows.select(order, "people", "saying", "basis", canonicalise(F.col("basis")).alias("claim")).where(F.char_length("claim") >= least)
    rows = keep_first(rows, ["claim"], order) if dedup else rows
    return rows.withColumn("processed", reduce_wording(F.col("basis")))


def claim_score(claim: Column, coverage: Column, support: Column, families: Column) -> Column:
    words = X.word_count(claim)
    low = F.lower(claim)
    opens = F.lit(False)
    for o in CLAIM_OPENERS:
        opens = opens | low.contains(o)
    score = coverage + 0.3 * support + F.when(words.between(5, 15), 0.5).when(words > 20, -0.2).otherwise(0.0) + F.when(opens, 0.3).otherwise(0.0)
    return F.round(score + F.when(families >= 3, 0.5 * families).otherwise(0.0), 3)


def aggregate_clusters(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row per cluster of (cluster, people, claim): modal claim (ties: least), coverage, support, cultures, families, mean words, score."""
    # claims are computed once, for counts that shrink map-side; hot clusters arrive aggregated
    base = cut(assigned.groupBy(cluster, "claim", "people").agg(F.count("*").alias("n")))
    per_claim = base.groupBy(cluster, "claim").agg(F.sum("n").alias("n"), (X.word_count(F.col("claim")) * F.sum("n")).alias("words"))
    claims = per_claim.groupBy(cluster).agg(F.min_by("claim", F.struct(-F.col("n"), "claim")).alias("claim"), F.sum("n").alias("support"), (F.sum("words") / F.sum("n")).alias("mean_words"))
    peoples = base.where("people is not null").select(cluster, "people").distinct().withColumn("family", family_of(F.col("people")))
    cultures = peoples.groupBy(cluster).agg(F.count("*").cast("int").alias("coverage"), F.array_sort(F.collect_set("people")).alias("cultures"), F.array_sort(F.collect_set("family")).alias("language_families"))
    joined = claims.join(cultures, cluster, "left").na.fill(0, ["coverage"])
    made = joined.withColumn("family_diversity", F.greatest(F.size(F.coalesce("language_families", F.array())), F.lit(0)))
    return made.select(
        cluster, "claim", claim_score(F.col("claim"), F.col("coverage"), F.col("support"), F.col("family_diversity")).alias("wisdom_score"), "coverage", F.col("support").cast("int").alias("support"),
        "cultures", "language_families", "family_diversity", F.round("mean_words", 1).alias("avg_claim_length"),
    )


def cluster_examples(assigned: DataFrame, cluster: str = "cluster_id", order: str = "row_id", most: int = 8) -> DataFrame:
    """(cluster, people, place, saying): one example per representative people.

    Peoples are walked by name; one is kept if it is among the first eight or its family has at most two peoples here. The saying is the first by input order.
    """
    firsts = assigned.where("people is not null").groupBy(cluster, "people").agg(F.min_by("saying", order).alias("saying")).withColumn("family", family_of(F.col("people")))
    sized = firsts.withColumn("of_family", F.count("*").over(Window.partitionBy(cluster, "family")))
    placed = sized.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy("people")))
    return placed.where((F.col("place") <= most) | (F.col("of_family") <= 2)).select(cluster, "people", "place", "saying")


def first_examples(examples: DataFrame, most: int, cluster: str = "cluster_id") -> DataFrame:
    """The first so many examples of each cluster in their order: six are shown with a cluster, four with one to be rated."""
    firsts = F.slice(F.sort_array(F.collect_list(F.struct("place", "people", "saying"))), 1, most)  # a row per representative people
    return examples.groupBy(cluster).agg(firsts.alias("e")).select(cluster, F.inline("e"))


def culture_count(rows: DataFrame) -> DataFrame:
    """One row: the rows and the distinct peoples among them."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("people").alias("n_peoples"))


def examples_map(examples: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("place", "people", "saying")))
    return examples.groupBy(cluster).agg(F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["people"], e["saying"]))).alias("examples"))


def ordered_clusters(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return clusters.orderBy(F.desc("wisdom_score"), F.desc("family_diversity"), F.desc("coverage"), cluster)
