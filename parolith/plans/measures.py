"""Queries on measures: n-gram settings, thresholds, pair similarity, silhouettes, stability, diagnosis of one clustering, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolith.functions import claims as C
from parolith.operators import clusters, diagnostics, experiments, linkage, tfidf
from parolith.plans.catalog import _METRICS, _TOP, _UNIT, _embedding_terms, _item_threshold, _item_blocks, _items, _metrics, MATRIX, claim_clusters, claim_rows, CLAIMS, L, query
from parolith.session import cut, table
from parolith.streaming import live
from parolith.plans.catalog import BASIS, KEEP_SQL, SCORE_SQL, sayings


# n-grams


def grams_sql(g: tfidf.Grams, source: str, name: str = "raw") -> str:
    """Common table expressions for the checking SQL: <name>(ord, term, w), not yet of unit length, from source(ord, claim)."""
    sizes = ", ".join(f"({n})" for n in range(g.least, g.most + 1))
    if g.kind == "word":
        stops = ", ".join(repr(w) for w in g.stop_words) or "''"
        cut_up = f"""words AS (SELECT ord, list_filter(regexp_extract_all(lower(claim), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stops})) AS ws FROM {source}),
grams AS (SELECT ord, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(list_slice(ws, i, i + n - 1), ' '))) AS term FROM words, (VALUES {sizes}) t(n) WHERE len(ws) >= n)"""
    else:
        cut_up = f"""words AS (SELECT ord, ' ' || w || ' ' AS w FROM (SELECT ord, unnest(string_split_regex(lower(claim), '\\s+')) AS w FROM {source}) WHERE w <> ''),
grams AS (SELECT ord, w AS term FROM words WHERE length(w) <= {g.least} UNION ALL SELECT ord, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) FROM words, (VALUES {sizes}) t(n) WHERE length(w) > n OR (length(w) = n AND n > {g.least}))"""
    cap = f"ORDER BY total DESC, term LIMIT {g.max_terms}" if g.max_terms else ""
    return f"""{cut_up},
tf AS (SELECT ord, term, count(*) AS tf FROM grams GROUP BY ALL), n AS (SELECT count(*) AS n FROM {source}),
terms AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) <= {g.max_share} * (SELECT n FROM n) {cap}),
{name} AS (SELECT ord, term, tf * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN terms USING (term))"""


_WEIGHTS = "SELECT ord AS id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY ord)), 6) AS w FROM raw"


def _weights(spark: SparkSession, sf_dir: str, g: tfidf.Grams) -> DataFrame:
    return tfidf.tfidf(table(spark, sf_dir, "items"), "ord", "claim", g).withColumn("w", F.round("w", 6))


@query(f"WITH {grams_sql(tfidf.THRESHOLD, 'items')} {_WEIGHTS}")
def threshold_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, tfidf.THRESHOLD)


@query(f"WITH {grams_sql(tfidf.COORDS_CHARS, 'items')} {_WEIGHTS}")
def coords_char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, tfidf.COORDS_CHARS)


@query(f"WITH {grams_sql(tfidf.COORDS_WORDS, 'items')} {_WEIGHTS}")
def coords_word_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, tfidf.COORDS_WORDS)


@query(f"WITH {grams_sql(tfidf.COORDS_FALLBACK, 'items')} {_WEIGHTS}")
def fallback_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, tfidf.COORDS_FALLBACK)


@query(f"WITH {grams_sql(tfidf.DIAGNOSTICS, 'items')} {_WEIGHTS}")
def diagnostics_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, tfidf.DIAGNOSTICS)


# thresholds and pairs

_DISTINCT = "firsts AS (SELECT min(ord) AS ord, claim FROM items GROUP BY claim)"


@query(
    f"""WITH {_DISTINCT}, {grams_sql(tfidf.THRESHOLD, 'firsts')}, u AS (SELECT ord, term, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS w FROM raw),
s AS (SELECT sum(s * s) AS q FROM (SELECT sum(w) AS s FROM u GROUP BY term)), m AS (SELECT count(DISTINCT ord) AS m FROM u), k AS (SELECT n, (q - m) / (m * (m - 1)) AS similarity FROM s, m, n)
SELECT round(CASE WHEN n < 50 THEN 0.25 WHEN n > 500 THEN 0.45 WHEN similarity > 0.3 THEN 0.35 * 0.8 WHEN similarity < 0.1 THEN 0.35 * 1.2 ELSE 0.35 END, 6) AS threshold FROM k"""
)
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold for the distinct claims: by their number, and between 50 and 500 by their mean similarity."""
    return spark.createDataFrame([(round(_item_threshold(spark, sf_dir), 6),)], "threshold double")


_PROCESSED = f"{_DISTINCT}, reduced AS (SELECT ord, {C.reduced_sql('claim')} AS claim FROM firsts)"


@query(
    f"""WITH {_PROCESSED}, {grams_sql(tfidf.CLUSTERING, 'reduced')}, u AS (SELECT ord, term, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS w FROM raw),
least AS (SELECT CASE WHEN n < 50 THEN 0.75 WHEN n > 500 THEN 0.55 ELSE 0.58 END AS least FROM n)
SELECT x.ord AS a, y.ord AS b, round(sum(x.w * y.w), 6) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.ord < y.ord GROUP BY x.ord, y.ord HAVING sum(x.w * y.w) >= (SELECT least FROM least)"""
)
def pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct claims that are nearer than the threshold for their number (that of a middling mean similarity aside)."""
    n = _items(spark, sf_dir).count()
    least = 0.75 if n < 50 else 0.55 if n > 500 else 0.58
    return tfidf.similar_pairs(_item_blocks(spark, sf_dir), least).withColumn("cosine", F.round("cosine", 6))


# quality of clusters


@query(
    f"""{_UNIT}, m AS (SELECT label, term, avg(w) AS m FROM u GROUP BY label, term), k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
d AS (SELECT u.vec_id, u.label AS own, m.label AS other, 1 - sum(u.w * m.m) AS d FROM u JOIN m USING (term) GROUP BY ALL),
ab AS (SELECT vec_id, any_value(n) AS n, max(CASE WHEN own = other THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM d JOIN k ON k.label = own WHERE n > 1 GROUP BY vec_id)
SELECT round(sum((b - a) / greatest(a, b)) / (SELECT count(*) FROM embeddings), 5) AS silhouette, '' AS note FROM ab"""
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine silhouette of labelled vectors: mean distances in closed form."""
    value, note = diagnostics.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(None if value is None else round(value, 5), note)], "silhouette double, note string")


_DISTANCES = f"""{_UNIT}, s AS (SELECT label, term, sum(w) AS s FROM u GROUP BY label, term), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY label), k AS (SELECT label, count(DISTINCT vec_id) AS size FROM u GROUP BY label),
d AS (SELECT 1 - (q - size) / (size * (size - 1)) AS distance FROM q JOIN k USING (label) WHERE size >= 2)"""


@query(f"{_DISTANCES} SELECT round(avg(distance), 6) AS compactness, count(*) AS n_clusters FROM d")
def overall_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.overall_compactness(diagnostics.compactness(_embedding_terms(spark, sf_dir))).withColumn("compactness", F.round("compactness", 6))


_KEPT = f"""WITH trials AS (SELECT * FROM (VALUES ('0.8', 0.8), ('0.9', 0.9), ('0.95', 0.95)) t(name, ratio), (VALUES (0), (1), (2)) d(draw)),
drawn AS (SELECT ratio, draw, claim FROM items, trials QUALIFY row_number() OVER (PARTITION BY ratio, draw ORDER BY md5('0/' || draw || '/' || name || '/' || ord), ord) <= floor((SELECT count(*) FROM items) * ratio + 1e-9)),
counted AS (SELECT ratio, draw, claim, count(*) AS n FROM drawn GROUP BY ALL),
best AS (SELECT ratio, draw, claim FROM counted QUALIFY row_number() OVER (PARTITION BY ratio, draw ORDER BY n DESC, claim) <= 5),
kept AS (SELECT ratio, draw, count(*) FILTER (WHERE claim IN ({_TOP})) / 5.0::DOUBLE AS kept FROM best GROUP BY ratio, draw)"""


@query(f"{_KEPT} SELECT round(avg(k), 6) AS stability FROM (SELECT avg(kept) AS k FROM kept GROUP BY ratio)")
def mean_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.mean_stability(diagnostics.stability(table(spark, sf_dir, "items"), "ord", "claim")).withColumn("stability", F.round("stability", 6))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unit vectors) of the embeddings with their labels as clusters and as claims."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.col("label").alias("cluster_id"), F.concat(F.lit("claim "), F.col("label")).alias("claim"))
    return rows, _embedding_terms(spark, sf_dir).select("id", F.col("term").cast("string").alias("term"), "w")


def _positive_silhouette() -> str:
    return f"""{_DISTANCES}, m AS (SELECT label, term, avg(w) AS m FROM u GROUP BY label, term),
dd AS (SELECT u.vec_id, u.label AS own, m.label AS other, 1 - sum(u.w * m.m) AS d FROM u JOIN m USING (term) GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN d * size / (size - 1) END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM dd JOIN k ON k.label = own WHERE size > 1 GROUP BY vec_id),
sil AS (SELECT sum((b - a) / greatest(a, b)) / (SELECT count(*) FROM embeddings) AS silhouette FROM ab),
named AS (SELECT vec_id AS ord, 'claim ' || label AS claim, label FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM named GROUP BY label)"""


_LABEL_TOP = "SELECT claim FROM (SELECT claim, count(*) AS n FROM named GROUP BY claim) ORDER BY n DESC, claim LIMIT 5"
_DIAGNOSIS = f"""{_positive_silhouette()}, kept AS (SELECT * FROM ({_KEPT.replace(_TOP, _LABEL_TOP).replace('FROM items', 'FROM named')} SELECT * FROM kept)),
figures AS (SELECT silhouette, (SELECT avg(distance) FROM d) AS compactness, (SELECT avg(k) FROM (SELECT avg(kept / (least(5, (SELECT count(*) FROM sizes)) / 5.0)) AS k FROM kept GROUP BY ratio)) AS stability FROM sil),
scored AS (SELECT *, round(least(greatest(8 * silhouette, 0), 4) + least(greatest(5 * (0.6 - compactness), 0), 3) + 3 * stability, 1) AS trust_score FROM figures)"""


def _diagnosis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, vectors = _labelled(spark, sf_dir)
    none = spark.createDataFrame([], "theme string, significant boolean")
    return diagnostics.diagnose(rows, "claim", "vec_id", vectors, none)


@query(
    f"""{_DIAGNOSIS} SELECT 'ok' AS status, round(silhouette, 5) AS silhouette, round(compactness, 5) AS compactness, round(stability, 5) AS stability, trust_score,
CASE WHEN trust_score >= 7 THEN 'High' WHEN trust_score >= 4 THEN 'Medium' ELSE 'Low' END AS trust_band, CASE WHEN (SELECT count(*) FROM embeddings) >= 100 THEN 'Good' ELSE 'Limited' END AS data_quality,
(SELECT count(*) FROM sizes) AS total_clusters, (SELECT max(n) FROM sizes) AS largest_cluster_size FROM scored"""
)
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of one clustering, all measured on it, and the trust score they give."""
    report = _diagnosis(spark, sf_dir)[0]
    figures = [F.round(c, 5).alias(c) for c in ("silhouette", "compactness", "stability")]
    return report.select("status", *figures, "trust_score", "trust_band", "data_quality", "total_clusters", "largest_cluster_size")


@query(
    f"""{_DIAGNOSIS}, codes AS (SELECT 'silhouette_low' AS code, 'High' AS priority FROM figures WHERE silhouette < 0.15 UNION ALL SELECT 'many_singletons', 'Medium' FROM sizes HAVING avg((n = 1)::INT) > 0.5
UNION ALL SELECT 'few_items', 'Medium' FROM sizes HAVING sum(n) < 100 UNION ALL SELECT 'one_sided', 'Low' FROM sizes HAVING max(n) > 10 * quantile_cont(n, 0.5) UNION ALL SELECT 'no_correlation', 'Low')
SELECT code, priority FROM codes"""
)
def diagnosis_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosis(spark, sf_dir)[1].select("code", "priority")


@query("SELECT 'insufficient_data' AS status, NULL::DOUBLE AS trust_score, 'too_few_claims' AS code, 'High' AS priority")
def diagnosis_of_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than three claims give a status and one piece of advice; here there is none at all."""
    rows, vectors = _labelled(spark, sf_dir)
    report, advice = diagnostics.diagnose(rows.where("vec_id is null"), "claim", "vec_id", vectors, spark.createDataFrame([], "theme string, significant boolean"))
    return report.select("status", "trust_score").crossJoin(advice.select("code", "priority"))  # one row each


@query(f"{_DIAGNOSIS} SELECT round(silhouette, 5) AS silhouette_score, round(compactness, 5) AS compactness_score, round(stability, 5) AS stability_score, trust_score AS overall_trust FROM scored")
def legacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diagnostics.legacy_summary(_diagnosis(spark, sf_dir)[0])
    return made.select(*[F.round(c, 5).alias(c) if c.endswith("_score") else F.col(c) for c in made.columns])


@query(f"{_METRICS}, high AS (SELECT 'Clusters are hardly separated' AS issue FROM metrics WHERE silhouette < 0.15) SELECT issue, count(*) AS n FROM high GROUP BY issue")
def main_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of high priority, over all families."""
    return diagnostics.main_issues(diagnostics.recommendations(_metrics(spark, sf_dir), F.lit(0))).groupBy("issue").agg(F.count("*").alias("n"))


_THEMES = [n for n, _ in L.DIAGNOSTIC_THEMES] + ["Other"]
_ONE_PROXY = " UNION ALL ".join(f"SELECT '{t}' AS theme, \"{t}\"::DOUBLE AS x, CASE urbanization_level WHEN 'Low' THEN 1 WHEN 'Med' THEN 2 WHEN 'High' THEN 3 END AS y FROM matrix JOIN people_metadata USING (people)" for t in _THEMES)


@query(
    f"""WITH {MATRIX}, long AS ({_ONE_PROXY}), kept AS (SELECT * FROM long WHERE y IS NOT NULL),
ranked AS (SELECT theme, rank() OVER (PARTITION BY theme ORDER BY x) + (count(*) OVER (PARTITION BY theme, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY theme ORDER BY y) + (count(*) OVER (PARTITION BY theme, y) - 1) / 2.0 AS ry FROM kept),
rho AS (SELECT theme, corr(rx, ry) AS r, count(*) AS sample_size FROM ranked GROUP BY theme)
SELECT theme, 'urbanization_level' AS meta_col, round(r, 6) AS correlation, sample_size FROM rho WHERE sample_size >= 3 AND r IS NOT NULL AND NOT isnan(r)"""
)
def correlations_of_present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that has one of the ordinal columns only."""
    meta = table(spark, sf_dir, "people_metadata").select("people", "region", "urbanization_level")
    made = diagnostics.rank_correlations(diagnostics.theme_matrix(claim_clusters(spark, sf_dir)), meta)
    return made.select("theme", "meta_col", F.round("correlation", 6).alias("correlation"), "sample_size")


_EXAMPLES = f"""WITH {CLAIMS}, firsts AS (SELECT claim, people, min_by(saying, row_id) AS saying, {L.family_sql('people')} AS family FROM long_enough GROUP BY claim, people),
placed AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY people) AS place, count(*) OVER (PARTITION BY claim, family) AS k FROM firsts), shown AS (SELECT claim, people, place::INT AS place, saying FROM placed WHERE place <= 8 OR k <= 2)
SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY claim ORDER BY place) <= """


@query(_EXAMPLES + "6")
def shown_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six examples of each cluster."""
    examples = clusters.cluster_examples(claim_rows(spark, sf_dir))
    return clusters.first_examples(examples, 6).select(F.col("cluster_id").alias("claim"), "people", "place", "saying")


@query(_EXAMPLES + "4")
def rating_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four examples, as shown to those who rate."""
    examples = clusters.cluster_examples(claim_rows(spark, sf_dir))
    return clusters.first_examples(examples, 4).select(F.col("cluster_id").alias("claim"), "people", "place", "saying")


# agreement and mixing


@query(
    """WITH l AS (SELECT label AS x, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT AS y, count(*) AS n FROM embeddings GROUP BY ALL), o AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM l),
x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM l GROUP BY x)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM l GROUP BY y))
SELECT round((o.v - x.v * y.v / (t * (t - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (t * (t - 1) / 2)), 9) AS adjusted_rand FROM o, x, y"""
)
def rand_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the labels with another grouping: the signs of the first two coordinates."""
    e = table(spark, sf_dir, "embeddings")
    signs = (F.get("embedding", F.lit(0)) > 0).cast("int") * 2 + (F.get("embedding", F.lit(1)) > 0).cast("int")
    made = experiments.rand_index(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), e.select(F.col("vec_id").alias("id"), signs.alias("cluster_id")))
    return made.withColumn("adjusted_rand", F.round("adjusted_rand", 9))


@query(
    """WITH m AS (SELECT ord, people, claim FROM items WHERE people IS NOT NULL), own AS (SELECT claim, count(*) AS size, count(DISTINCT people) AS n_values FROM m GROUP BY claim), widest AS (SELECT max(size) AS w FROM own),
each AS (SELECT round, people, row_number() OVER (PARTITION BY round ORDER BY md5('0/' || round || '/' || ord), ord) AS place FROM m, range(200) r(round)),
firsts AS (SELECT round, people, min(place) AS place FROM each WHERE place <= (SELECT w FROM widest) GROUP BY round, people),
drawn AS (SELECT size, round, count(*) AS random_values FROM firsts, (SELECT DISTINCT size FROM own) WHERE place <= size GROUP BY ALL)
SELECT claim, n_values, round(avg(CASE WHEN random_values <= n_values THEN 100.0 ELSE 0.0 END), 6) AS percentile FROM own JOIN drawn USING (size) GROUP BY claim, n_values"""
)
def mixing_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How mixed the peoples of equal claims are, against random draws."""
    members = table(spark, sf_dir, "items").where("people is not null").select("ord", "people", "claim")
    made = experiments.mixing_baseline(members, "people", "claim", "ord")
    return made.withColumn("percentile", F.round("percentile", 6))


@query("SELECT * FROM (SELECT x.label AS x, y.label AS y, round(sum(x.w * y.w), 6) AS dot FROM (SELECT label, term, avg(v / l) AS w FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS term FROM embeddings) JOIN (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z))) AS l FROM embeddings) USING (vec_id) GROUP BY label, term) x JOIN (SELECT label, term, avg(v / l) AS w FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS term FROM embeddings) JOIN (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z))) AS l FROM embeddings) USING (vec_id) GROUP BY label, term) y USING (term) GROUP BY 1, 2) WHERE x < y")
def label_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine between the members of two clusters: the product of their mean vectors, as average linkage takes it."""
    v = _embedding_terms(spark, sf_dir)
    means = cut(v.groupBy("cluster_id", "term").agg(F.avg("w").alias("m")))
    x, y = means.toDF("x", "term", "mx"), means.toDF("y", "term", "my")
    return x.join(y, "term").where("x < y").groupBy("x", "y").agg(F.round(F.sum(F.col("mx") * F.col("my")), 6).alias("dot"))


# streams


@query(
    f"""WITH {BASIS.replace('SELECT row_id, people, original,', 'SELECT row_id, people, original, ingested_at,')}
SELECT date_trunc('day', ingested_at) AS start, people, count(*) AS n, round(avg({SCORE_SQL}), 6) AS avg_quality FROM based WHERE {KEEP_SQL} GROUP BY 1, 2"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per people and day of ingestion on a file stream; the watermark is later than the data is spread, so no row is late."""
    return live.window_counts_once(spark, f"{sf_dir}/sayings_raw.parquet*", sayings(spark, sf_dir).schema, "ingested_at").withColumn("avg_quality", F.round("avg_quality", 6))


@query("SELECT ord, rating_id, coherence, quality, remark, rated_at FROM ratings QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rated_at DESC, rating_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rating of each claim, kept up to date from a file stream."""
    return live.upsert_once(spark, f"{sf_dir}/ratings.parquet*", table(spark, sf_dir, "ratings").schema, "ord", "rated_at", "rating_id").select("ord", "rating_id", "coherence", "quality", "remark", "rated_at")
