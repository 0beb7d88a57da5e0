"""Human ratings: which clusters to show, the newest rating of each, and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolith.functions.labels import COHERENCE, QUALITY, on_scale
from parolith.operators.diagnostics import hash_order


def validation_sample(clusters: DataFrame, cluster: str = "cluster_id", top: int = 5, others: int = 5, seed: int = 0) -> DataFrame:
    """The five best clusters and five drawn from the rest by a seeded hash; part tells which."""
    best = clusters.orderBy(F.desc("wisdom_score"), cluster).limit(top)
    rest = clusters.join(F.broadcast(best.select(cluster)), cluster, "left_anti")
    drawn = rest.orderBy(hash_order(F.lit(seed), F.col(cluster)), cluster).limit(others)
    return best.withColumn("part", F.lit("top")).unionByName(drawn.withColumn("part", F.lit("drawn")))


def latest_ratings(ratings: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest rating of each key (ties: the greatest id): an aggregate with partial maxima, no sort."""
    rest = [c for c in ratings.columns if c != key]
    best = ratings.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return best.select(key, "r.*")


def rating_summary(ratings: DataFrame, remark: str = "comment") -> DataFrame:
    """One row: ratings, mean coherence and quality, clusters with a problem, remarks, bands and overall verdict; unknown words count as the middle."""
    scored = ratings.select(on_scale(F.col("coherence"), COHERENCE).alias("c"), on_scale(F.col("quality"), QUALITY).alias("q"), F.coalesce(F.trim(remark), F.lit("")).alias("remark"))
    made = scored.agg(F.count("*").alias("n_ratings"), F.avg("c").alias("avg_coherence"), F.avg("q").alias("avg_quality"), F.count_if(F.col("c") <= 2).alias("problem_clusters"), F.count_if(F.col("remark") != "").alias("n_remarks"))
    c, q = F.col("avg_coherence"), F.col("avg_quality")
    return made.withColumns({
        "coherence_band": F.when(c >= 4, "High").when(c >= 3, "Moderate").otherwise("Low"),
        "quality_band": F.when(q >= 3, "Good").when(q >= 2, "Fair").otherwise("Poor"),
        "verdict": F.when((c >= 3.5) & (q >= 2.5), "good").when((c >= 2.5) | (q >= 2), "mixed").otherwise("poor"),
    })


def rating_span(ratings: DataFrame, time: str = "rated_at") -> DataFrame:
    """Seconds from the first to the last rating."""
    return ratings.agg((F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))).alias("us")).select((F.col("us") / 1e6).alias("seconds"))


def export_ratings(ratings: DataFrame) -> DataFrame:
    """Each rating as one JSON text."""
    form = {k: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for k in ("timestampFormat", "timestampNTZFormat")}  # to the microsecond
    return ratings.select(F.to_json(F.struct(*[F.col(c) for c in sorted(ratings.columns)]), form).alias("json"))
