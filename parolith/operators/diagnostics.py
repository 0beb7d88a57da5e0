"""Quality of clusters: sizes, silhouette, compactness, stability, rank correlation, trust score, recommendations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions.labels import DIAGNOSTIC_THEMES, low_med_high, theme_of, trust_band
from parolith.session import cut

PROXIES = ("maritime_orientation", "urbanization_level", "individualism_proxy", "uncertainty_avoidance_proxy")


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: clusters, items, singletons, largest, median and mean size."""
    sizes = assigned.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("total_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), F.count_if(F.col("n") == 1).alias("singleton_clusters"),
        F.max("n").alias("largest_cluster_size"), F.percentile("n", 0.5).alias("median_cluster_size"), F.avg("n").alias("mean_cluster_size"),
    )


def score_quantiles(clusters: DataFrame, score: str = "wisdom_score") -> DataFrame:
    """One row: least, greatest and mean score, and how many clusters reach the 80th or stay within the 20th percentile (linear)."""
    bounds = clusters.agg(F.percentile(score, 0.8).alias("hi"), F.percentile(score, 0.2).alias("lo"))
    near = F.lit(1e-9)
    return clusters.crossJoin(F.broadcast(bounds)).agg(  # one row of bounds
        F.min(score).alias("least"), F.max(score).alias("greatest"), F.avg(score).alias("mean_score"),
        F.count_if(F.col(score) >= F.col("hi") - near).alias("high_count"), F.count_if(F.col(score) <= F.col("lo") + near).alias("low_count"),
    )


def compactness(vectors: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, size, distance): mean pairwise cosine distance in each cluster of two or more, in closed form from sums; vectors are (id, cluster, term, w)."""
    sizes = vectors.select("id", cluster).distinct().groupBy(cluster).agg(F.count("*").alias("size"))
    squares = vectors.groupBy(cluster, "term").agg(F.sum("w").alias("s")).groupBy(cluster).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return sizes.join(squares, cluster).where("size >= 2").select(cluster, "size", (1 - (F.col("q") - F.col("size")) / (F.col("size") * (F.col("size") - 1))).alias("distance"))


def silhouette(rows: DataFrame, vector: str, label: str) -> tuple[float | None, str]:
    """(cosine silhouette, note); undefined with fewer than two clusters or singletons alone. Zero vectors take no part."""
    rows = rows.where(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x) > 0)
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max("n").alias("most")).first()
    if counts["k"] < 2:
        return None, "fewer than two clusters"
    if counts["most"] < 2:
        return None, "all clusters are singletons"
    made = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(made), ""


def term_silhouette(vectors: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: mean cosine silhouette of vectors (id, cluster, term, w) of non-negative weights; null where silhouette() is undefined.

    A mean distance to a cluster is 1 less the product with its mean vector. Rows alone in their cluster count as 0 and meet no other cluster.
    """
    sizes = vectors.select("id", cluster).distinct().groupBy(cluster).agg(F.count("*").alias("n"))
    means = vectors.groupBy(cluster, "term").agg(F.sum("w").alias("s")).join(sizes, cluster)
    means = cut(means.select(F.col(cluster).alias("other"), "term", (F.col("s") / F.col("n")).alias("m")))
    rows = cut(vectors.join(sizes.where("n >= 2"), cluster).select("id", F.col(cluster).alias("own"), "n", "term", "w"))
    dots = rows.join(means, "term").groupBy("id", "own", "n", "other").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    inside = F.max(F.when(F.col("other") == F.col("own"), (F.col("dot") * F.col("n") - 1) / (F.col("n") - 1)))
    # a cluster that shares no term is at distance 1
    outside = F.coalesce(F.max(F.when(F.col("other") != F.col("own"), F.col("dot"))), F.lit(0.0))
    each = dots.groupBy("id", "n").agg((1 - inside).alias("a"), (1 - outside).alias("b"))
    score = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    total = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("k"), F.max("n").alias("most"))
    return total.crossJoin(each.agg(F.sum(score).alias("sum"))).select(F.when((F.col("k") >= 2) & (F.col("most") >= 2), F.col("sum") / F.col("rows")).alias("silhouette"))  # one row each


def hash_order(*parts: Column) -> Column:
    """A number that orders rows at random, the same in every run and every engine."""
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def hash_head(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, h: str, tie: str) -> DataFrame:
    """Of each key the first ``k`` rows in the order of a hexadecimal hash (ties: the tie column); wanted has the keys and k.

    The hash's first three digits part a key's rows into 4,096 ranges that are counted map-side. Ranges wholly inside are taken as
    they are, and only the rows of the one range that k falls into are ranked, so no task meets all rows of a key.
    """
    rows = rows.withColumn("_range", F.substring(h, 1, 3))
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")))  # 4,096 rows a key
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys]
    named = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in keys], F.col("k").cast("long").alias("_k"))
    spans = upto.join(named, reduce(lambda x, y: x & y, same))
    spans = spans.where(F.col("_upto") - F.col("_n") < F.col("_k")).select(*[F.col(c).alias(f"_s_{c}") for c in keys], F.col("_range").alias("_s_range"), (F.col("_upto") <= F.col("_k")).alias("_whole"), (F.col("_k") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys], F.col("_range") == F.col("_s_range"))
    inside = rows.join(spans, match).drop(*[f"_s_{c}" for c in keys], "_s_range")
    edge = inside.where("not _whole").withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(h, tie))).where("_place <= _left")
    return inside.where("_whole").drop("_whole", "_left", "_range").unionByName(edge.drop("_whole", "_left", "_range", "_place"))


def stability(claims: DataFrame, id_col: str, claim: str, ratios=(0.8, 0.9, 0.95), draws: int = 3, top: int = 5, seed: int = 0) -> DataFrame:
    """(ratio, draw, kept): the share of the most frequent claims that stay most frequent in a seeded subsample.

    A subsample holds the first int(n ratio) rows in the order of a hash, found by ranges (``hash_head``). Fewer distinct claims than ``top`` are all top.
    """
    spark = claims.sparkSession
    rows = claims.select(F.col(id_col).alias("id"), F.col(claim).alias("claim"))
    total = rows.count()
    trials = spark.createDataFrame([(float(r), d, int(math.floor(total * r + 1e-9))) for r in ratios for d in range(draws)], "ratio double, draw int, k long")
    each = rows.join(F.broadcast(trials.drop("k")), F.lit(True)).withColumn("h", hash_order(F.lit(seed), F.col("draw"), F.col("ratio"), F.col("id")))
    drawn = hash_head(each, ["ratio", "draw"], trials, "h", "id")

    def most(df: DataFrame, keys: list[str]) -> DataFrame:
        counted = df.groupBy(*keys, "claim").agg(F.count("*").alias("n"))
        first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "claim"))), 1, top)
        # the best of each slice, then the best of all: no task sees all claims
        some = counted.groupBy(*keys, F.pmod(F.xxhash64("claim"), F.lit(1024)).alias("slice")).agg(first.alias("c")).select(*keys, F.explode("c").alias("c"))
        return some.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("c")), 1, top).alias("c")).select(*keys, F.explode("c").alias("c")).select(*keys, "c.claim")

    whole = most(rows, [])
    k = whole.count()
    kept = most(drawn, ["ratio", "draw"]).join(F.broadcast(whole), "claim", "left_semi").groupBy("ratio", "draw").agg(F.count("*").alias("c"))  # top rows
    return trials.join(kept, ["ratio", "draw"], "left").select("ratio", "draw", (F.coalesce("c", F.lit(0)) / F.lit(max(k, 1))).alias("kept"))


def mean_stability(kept: DataFrame) -> DataFrame:
    """One row: the mean over the ratios of the mean over the draws."""
    return kept.groupBy("ratio").agg(F.avg("kept").alias("kept")).agg(F.avg("kept").alias("stability"))


def overall_compactness(distances: DataFrame) -> DataFrame:
    """One row: the mean of the clusters' mean distances; null where no cluster has two members."""
    return distances.agg(F.avg("distance").alias("compactness"), F.count("*").alias("n_clusters"))


def theme_matrix(clusters: DataFrame, cultures: str = "cultures") -> DataFrame:
    """(people, one count per theme): in how many clusters of each theme a people takes part."""
    names = [n for n, _ in DIAGNOSTIC_THEMES] + ["Other"]
    each = clusters.select(theme_of(F.col("claim"), DIAGNOSTIC_THEMES).alias("theme"), F.explode(cultures).alias("people"))
    return each.groupBy("people").pivot("theme", names).count().na.fill(0)


def average_ranks(df: DataFrame, value: str, keys: list[str]) -> Column:
    """Average rank of a value within keys: ties share their mean place."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0


def rank_correlations(matrix: DataFrame, metadata: DataFrame, least: int = 3) -> DataFrame:
    """(theme, meta_col, correlation, p_value, sample_size, significant) of theme counts with ordinal metadata (Spearman).

    Peoples match by exact name; values other than Low, Med and High are left out; undefined correlations give no row.
    """
    themes = [c for c in matrix.columns if c != "people"]
    proxies = [c for c in PROXIES if c in metadata.columns]
    joined = matrix.join(metadata.select("people", *proxies), "people")
    pairs = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(p).alias("meta_col"), F.col(f"`{t}`").cast("double").alias("x"), low_med_high(F.col(p)).cast("double").alias("y")) for t in themes for p in proxies])
    long = joined.select(F.explode(pairs).alias("z")).select("z.*").where("y is not null")
    ranked = long.withColumn("rx", average_ranks(long, "x", ["theme", "meta_col"])).withColumn("ry", average_ranks(long, "y", ["theme", "meta_col"]))
    spread = F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    rho = ranked.groupBy("theme", "meta_col").agg((F.covar_pop("rx", "ry") / spread).alias("correlation"), F.count("*").alias("sample_size")).where((F.col("sample_size") >= least) & F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    p = F.udf(lambda r, n: spearman_p(r, n), "double", useArrow=False)  # a row per theme and proxy, 24 at most
    return rho.withColumn("p_value", p("correlation", "sample_size")).withColumn("significant", F.col("p_value") < 0.05)


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    v = n - 2
    t2 = rho * rho * v / (1 - rho * rho)
    return incomplete_beta(v / (v + t2), v / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = 1 + step / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def trust_score(sil: Column, compact: Column, stable: Column) -> Column:
    """0 to 10: up to 4 for the silhouette, 3 for compactness, 3 for stability; what is undefined adds nothing."""

    def known(c: Column, points: Column) -> Column:
        return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(points)

    def clip(c: Column, high: float) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(high))

    return F.round(known(sil, clip(8 * sil, 4.0)) + known(compact, clip(5 * (0.6 - compact), 3.0)) + known(stable, 3 * stable), 1)


def trust_report(metrics: DataFrame) -> DataFrame:
    """Adds trust_score, trust_band and data_quality to rows with silhouette, compactness, stability and total_items."""
    scored = metrics.withColumn("trust_score", trust_score(F.col("silhouette"), F.col("compactness"), F.col("stability")))
    return scored.withColumn("trust_band", trust_band(F.col("trust_score"))).withColumn("data_quality", F.when(F.col("total_items") >= 100, "Good").otherwise("Limited"))


def legacy_summary(report: DataFrame) -> DataFrame:
    """The four figures under their older names."""
    return report.select(F.col("silhouette").alias("silhouette_score"), F.col("compactness").alias("compactness_score"), F.col("stability").alias("stability_score"), F.col("trust_score").alias("overall_trust"))


def recommendations(metrics: DataFrame, significant: Column) -> DataFrame:
    """(code, issue, action, priority) for every rule that a row of metrics meets.

    metrics has silhouette, singleton_clusters, total_clusters, total_items, largest_cluster_size, median_cluster_size; significant counts significant correlations.
    """
    sil = F.col("silhouette")
    undefined = sil.isNull() | F.isnan(sil)
    share = F.col("singleton_clusters") / F.greatest(F.col("total_clusters"), F.lit(1))
    rules = (
        (undefined, "silhouette_undefined", F.lit("Silhouette is undefined"), "Lower the distance threshold so that clusters of several items form", "High"),
        (~undefined & (sil < 0.15), "silhouette_low", F.lit("Clusters are hardly separated"), "Improve the wording reduction or change the threshold", "High"),
        (share > 0.5, "many_singletons", F.concat(F.format_number(100 * share, 1), F.lit("% singleton clusters")), "Raise the distance threshold", "Medium"),
        (F.col("total_items") < 100, "few_items", F.lit("Little data"), "Add sources or languages", "Medium"),
        (F.col("largest_cluster_size") > 10 * F.col("median_cluster_size"), "one_sided", F.lit("Very uneven cluster sizes"), "Look for generic claims or faults in the data", "Low"),
        (significant == 0, "no_correlation", F.lit("No significant correlation with metadata"), "Add more diverse peoples or check the metadata", "Low"),
    )
    rows = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), issue.alias("issue"), F.lit(action).alias("action"), F.lit(priority).alias("priority"))) for test, code, issue, action, priority in rules]), lambda r: r.isNotNull())
    return metrics.select(F.explode(rows).alias("r")).select("r.*")


def main_issues(found: DataFrame) -> DataFrame:
    """The issues of high priority among recommendations."""
    return found.where(F.col("priority") == "High").select("issue")


def diagnose(assigned: DataFrame, claim: str, id_col: str, vectors: DataFrame, correlations: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(report, recommendations) of one clustering: assigned has id_col, cluster_id and claims, vectors (id, term, w) are its unit vectors.

    report: one row with status, silhouette, compactness, stability, the sizes, trust_score, trust_band and data_quality. With fewer
    than ``least`` claims the status is "insufficient_data", the figures are null and the one recommendation is to add data.
    """
    spark = assigned.sparkSession
    sizes = cluster_sizes(assigned)
    if not enough_data(assigned, least):
        empty = sizes.select(F.lit("insufficient_data").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("silhouette", "compactness", "stability")], "*")
        none = empty.withColumns({"trust_score": F.lit(None).cast("double"), "trust_band": F.lit(None).cast("string"), "data_quality": F.lit("Limited")})
        return none, spark.createDataFrame([("too_few_claims", "Too few claims", "Add more data", "High")], "code string, issue string, action string, priority string")
    placed = cut(vectors.join(assigned.select(F.col(id_col).alias("id"), "cluster_id"), "id"))
    row = sizes.crossJoin(term_silhouette(placed)).crossJoin(overall_compactness(compactness(placed)).select("compactness"))  # one row each
    row = row.crossJoin(mean_stability(stability(assigned, id_col, claim)))
    row = cut(row.crossJoin(correlations.agg(F.count_if("significant").alias("n_significant"))))
    report = trust_report(row).select(F.lit("ok").alias("status"), "silhouette", "compactness", "stability", *sizes.columns, "trust_score", "trust_band", "data_quality")
    return report, recommendations(row, F.col("n_significant"))


def enough_data(claims: DataFrame, least: int = 3) -> bool:
    return len(claims.limit(least).collect()) >= least
