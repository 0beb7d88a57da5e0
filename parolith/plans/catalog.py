"""Registry of the core queries: name -> callable(spark, sf_dir), and name -> SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolith import engine
from parolith.functions import claims as C
from parolith.functions import labels as L
from parolith.functions import patterns as P
from parolith.functions import text as X
from parolith.operators import clean, clusters, diagnostics, embed, experiments, interpret, linkage, tfidf, validation
from parolith.session import cut, ensure_checkpoint_dir, table
from parolith.sources import pages
from parolith.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(pattern: str) -> str:
    """A pattern inside an SQL text."""
    return pattern.replace("'", "''")


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{P.S}]+|[{P.S}]+$', '', 'g')"


def words_sql(c: str) -> str:
    return f"(CASE WHEN {trim_sql(c)} = '' THEN 0 ELSE len(regexp_split_to_array({trim_sql(c)}, '[{P.S}]+')) END)"


def normal_sql(c: str) -> str:
    return trim_sql(f"regexp_replace(regexp_replace(coalesce({c}, ''), '{q(X.LABEL)}', '\\1', 'g'), '[{P.S}]+', ' ', 'g')")


def hit(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{q(pattern)}')"


NAME_SQL = (
    f"({hit('basis', X.NAME_FURNITURE)} OR {hit('basis', X.CATEGORY_TRAP)} OR (len(regexp_extract_all(basis, '{q(X.NAME_TOKEN)}')) BETWEEN 1 AND 3 "
    f"AND len(list_filter(regexp_extract_all(basis, '{q(X.NAME_TOKEN)}'), lambda t: NOT {hit('t', X.CAPITAL_START)})) = 0))"
)
CUES_SQL = f"({hit('basis', X.SENTENCE_MARK)} OR {hit('basis', P.whole_words(X.CLEANER_CUES))})"
BASIS = f"""basis AS (
  SELECT row_id, people, original, {normal_sql('saying')} AS saying, {normal_sql('english_equivalent')} AS eq FROM sayings_raw),
based AS (SELECT *, CASE WHEN eq <> '' THEN eq ELSE saying END AS basis FROM basis)"""
KEEP_SQL = f"(length(basis) >= 6 AND NOT ({NAME_SQL} AND NOT {CUES_SQL}) AND NOT {hit('basis', X.NAVIGATIONAL)} AND NOT {hit('basis', X.BIBLIOGRAPHIC)})"
CLEAN = f"""{BASIS},
kept AS (SELECT *, CASE WHEN {trim_sql("coalesce(original, '')")} = '' THEN saying ELSE original END AS filled FROM based WHERE {KEEP_SQL}),
clean AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY people, basis ORDER BY row_id) = 1)"""
SCORE_SQL = f"(2 * {hit('basis', X.SENTENCE_MARK)}::INT + 2 * {hit('basis', P.whole_words(X.SCORE_CUES))}::INT + ({words_sql('basis')} >= 5)::INT + (length(basis) >= 20)::INT)"
CLAIMS = f"""named AS (SELECT row_id, people, saying, english_equivalent FROM sayings_raw WHERE people IS NOT NULL AND saying IS NOT NULL),
based AS (SELECT *, CASE WHEN {trim_sql("coalesce(english_equivalent, '')")} <> '' THEN english_equivalent ELSE saying END AS basis FROM named),
claimed AS (SELECT row_id, people, saying, basis, {C.canonical_sql('basis')} AS claim FROM based WHERE {trim_sql('basis')} <> ''),
long_enough AS (SELECT * FROM claimed WHERE length(claim) >= 10)"""
BY_CLAIM = f"""{CLAIMS},
cultures AS (SELECT claim, count(*) AS coverage, list_sort(list(people)) AS cultures, count(DISTINCT family) AS families, list_sort(list(DISTINCT family)) AS language_families
  FROM (SELECT DISTINCT claim, people, {L.family_sql('people')} AS family FROM long_enough) GROUP BY claim),
sized AS (SELECT claim, count(*) AS support FROM long_enough GROUP BY claim),
grouped AS (SELECT *, {words_sql('claim')} AS words FROM cultures JOIN sized USING (claim)),
scored AS (SELECT *, round(coverage + 0.3 * support + CASE WHEN words BETWEEN 5 AND 15 THEN 0.5 WHEN words > 20 THEN -0.2 ELSE 0 END
  + CASE WHEN contains(lower(claim), 'if ') OR contains(lower(claim), 'when ') OR contains(lower(claim), 'better ') OR contains(lower(claim), 'avoid ') OR contains(lower(claim), 'never ') THEN 0.3 ELSE 0 END
  + CASE WHEN families >= 3 THEN 0.5 * families ELSE 0 END, 3) AS wisdom_score FROM grouped)"""


def sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sayings_raw")


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their claim, before claims are made distinct: clusters of equal claims."""
    return clusters.prepare_claims(sayings(spark, sf_dir), dedup=False).withColumn("cluster_id", F.col("claim"))


def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.aggregate_clusters(claim_rows(spark, sf_dir).drop("cluster_id").withColumn("key", F.col("claim")), "key").drop("key")


# cleaning


@query(f"SELECT row_id, {normal_sql('saying')} AS saying_norm, {normal_sql('english_equivalent')} AS eq_norm FROM sayings_raw")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("row_id", X.normalise_text(F.col("saying")).alias("saying_norm"), X.normalise_text(F.col("english_equivalent")).alias("eq_norm"))


@query(f"WITH {BASIS} SELECT row_id, basis, length(basis) AS n_chars, {words_sql('basis')} AS n_words FROM based")
def basis_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_basis(sayings(spark, sf_dir)).select("row_id", "basis", F.char_length("basis").cast("long").alias("n_chars"), X.word_count(F.col("basis")).cast("long").alias("n_words"))


@query(f"WITH {BASIS} SELECT row_id, {NAME_SQL} AS name_like, {CUES_SQL} AS cues, {hit('basis', X.NAVIGATIONAL)} AS navigational, {hit('basis', X.BIBLIOGRAPHIC)} AS bibliographic, {KEEP_SQL} AS keep FROM based")
def keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("basis")
    return clean.with_basis(sayings(spark, sf_dir)).select("row_id", X.name_like(b).alias("name_like"), X.cleaner_cues(b).alias("cues"), X.navigational(b).alias("navigational"), X.bibliographic(b).alias("bibliographic"), X.keep_basis(b).alias("keep"))


@query(f"WITH {CLEAN} SELECT row_id, people, basis, filled AS original FROM clean")
def clean_sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_sayings(sayings(spark, sf_dir)).select("row_id", "people", "basis", "original")


@query(f"WITH {CLEAN} SELECT row_id, people, basis, {SCORE_SQL}::INT AS quality_score FROM clean ORDER BY 4 DESC, 2, 1")
def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.rank_quality(clean.clean_sayings(sayings(spark, sf_dir))).select("row_id", "people", "basis", "quality_score")


_T = trim_sql("coalesce(saying, '')")
_BIB = (
    f"({_T} = '' OR {hit(_T, X.BIBLIOGRAPHIC)} OR {hit(_T, X.FILTER_BAD)} OR ({hit(_T, X.CITATION_YEAR)} AND {hit(_T, X.CITATION_NEXT)}) OR ({words_sql('t0')} > 40 AND NOT {hit(_T, X.SENTENCE_MARK)}))"
)
_OPENER = rf"(?i)^(?:{'|'.join(X.FILTER_OPENERS)})(?:$|[^{P.W}])"
_FCUES = f"({hit('t0', X.SENTENCE_MARK)} OR {hit('t0', P.whole_words(X.FILTER_CUES))} OR {hit('t0', _OPENER)})"


@query(
    f"""WITH t AS (SELECT row_id, saying, coalesce(saying, '') AS t0 FROM sayings_raw),
f AS (SELECT row_id, {_BIB} AS bibliography, {_FCUES} AS cues, {words_sql('t0')} AS n FROM t)
SELECT row_id, bibliography, cues, CASE WHEN bibliography THEN false WHEN cues AND n <= 40 THEN true ELSE NOT bibliography AND cues END AS keep FROM f"""
)
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.coalesce("saying", F.lit(""))
    return sayings(spark, sf_dir).select("row_id", X.filter_bibliography(s).alias("bibliography"), X.filter_cues(s).alias("cues"), X.filter_cascade(s).alias("keep"))


@query(f"WITH {CLEAN} SELECT people, count(*) AS n_rows, avg({SCORE_SQL}) AS avg_quality FROM clean WHERE people IS NOT NULL GROUP BY people")
def quality_by_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = clean.clean_sayings(sayings(spark, sf_dir)).withColumn("s", X.quality_score(F.col("basis")))
    return ranked.where("people is not null").groupBy("people").agg(F.count("*").alias("n_rows"), F.avg("s").alias("avg_quality"))


# claims


@query(f"SELECT row_id, {C.canonical_sql('saying')} AS claim FROM sayings_raw")
def canonicalize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("row_id", C.canonicalise(F.col("saying")).alias("claim"))


@query(f"SELECT ord, {C.canonical_sql('saying')} AS claim, {C.reduced_sql('claim')} AS processed FROM items")
def canonicalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "items").select("ord", C.canonicalise(F.col("saying")).alias("claim"), C.reduce_wording(F.col("claim")).alias("processed"))


@query(f"SELECT row_id, {C.reduced_sql('saying')} AS processed FROM sayings_raw")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("row_id", C.reduce_wording(F.col("saying")).alias("processed"))


@query(f"WITH {CLAIMS} SELECT row_id, people, claim, {C.reduced_sql('basis')} AS processed FROM long_enough QUALIFY row_number() OVER (PARTITION BY claim ORDER BY row_id) = 1")
def dedup_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.prepare_claims(sayings(spark, sf_dir)).select("row_id", "people", "claim", "processed")


@query(f"WITH {BY_CLAIM} SELECT claim, wisdom_score, coverage::INT AS coverage, support::INT AS support, array_to_string(cultures, '|') AS cultures, array_to_string(language_families, '|') AS language_families, families::INT AS family_diversity, round(words, 1) AS avg_claim_length FROM scored")
def exact_claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = claim_clusters(spark, sf_dir)
    return made.withColumns({"cultures": F.array_join("cultures", "|"), "language_families": F.array_join("language_families", "|")})


@query(
    f"""WITH {CLAIMS},
firsts AS (SELECT claim, people, min_by(saying, row_id) AS saying, {L.family_sql('people')} AS family FROM long_enough GROUP BY claim, people),
placed AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY people) AS place, count(*) OVER (PARTITION BY claim, family) AS k FROM firsts)
SELECT claim, people, place::INT AS place, saying FROM placed WHERE place <= 8 OR k <= 2"""
)
def cluster_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_examples(claim_rows(spark, sf_dir)).select(F.col("cluster_id").alias("claim"), "people", "place", "saying")


@query(f"WITH {BY_CLAIM} SELECT claim, wisdom_score, coverage::INT AS coverage, support::INT AS support FROM scored ORDER BY wisdom_score DESC, families DESC, coverage DESC, claim LIMIT 15")
def top_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = clusters.ordered_clusters(claim_clusters(spark, sf_dir), "claim")
    return ordered.select("claim", "wisdom_score", "coverage", "support").limit(15)


@query(f"SELECT people, {L.family_sql('people')} AS family, count(*) AS n_rows FROM sayings_raw WHERE people IS NOT NULL GROUP BY people")
def family_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sayings(spark, sf_dir).where("people is not null").groupBy("people").agg(F.count("*").alias("n_rows"))
    return counted.select("people", L.family_of(F.col("people")).alias("family"), "n_rows")


@query(f"WITH {BY_CLAIM} SELECT {L.theme_sql('claim')} AS theme, {L.theme_sql('claim', L.DIAGNOSTIC_THEMES)} AS short_theme, count(*) AS n_claims, sum(support)::BIGINT AS n_rows FROM scored GROUP BY 1, 2")
def theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = claim_clusters(spark, sf_dir).select(L.theme_of(F.col("claim")).alias("theme"), L.theme_of(F.col("claim"), L.DIAGNOSTIC_THEMES).alias("short_theme"), "support")
    return made.groupBy("theme", "short_theme").agg(F.count("*").alias("n_claims"), F.sum("support").alias("n_rows"))


_THEMES = [n for n, _ in L.DIAGNOSTIC_THEMES] + ["Other"]
MATRIX = f"""{BY_CLAIM},
themed AS (SELECT {L.theme_sql('claim', L.DIAGNOSTIC_THEMES)} AS theme, unnest(cultures) AS people FROM scored),
matrix AS (SELECT people, {', '.join(f'count(*) FILTER (WHERE theme = {t!r}) AS "{t}"' for t in _THEMES)} FROM themed GROUP BY people)"""


@query(f"WITH {MATRIX} SELECT * FROM matrix")
def theme_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.theme_matrix(claim_clusters(spark, sf_dir))


# interpretation


def _profile_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT claim, coverage, place, '{t}' AS attribute, coalesce({c}, 'None') AS label FROM met" for t, c in interpret.PROFILE.items())
    return f"""{BY_CLAIM},
met AS (SELECT s.claim, s.coverage, s.place, m.* FROM (SELECT claim, coverage, unnest(cultures) AS person, generate_subscripts(cultures, 1) AS place FROM scored) s JOIN people_metadata m ON lower(m.people) = lower(s.person)),
long AS ({parts}),
counted AS (SELECT claim, coverage, attribute, label, count(*) AS n, min(place) AS first FROM long GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim, attribute ORDER BY n DESC, first) AS place FROM counted QUALIFY place <= 3)"""


def _claim_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return claim_clusters(spark, sf_dir), table(spark, sf_dir, "people_metadata")


@query(f"WITH {_profile_sql()} SELECT claim, attribute, label, n::INT AS n, place::INT AS place FROM ranked")
def metadata_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, meta = _claim_profiles(spark, sf_dir)
    return interpret.profile_counts(made, meta, "claim")


_PIVOT = ", ".join(f"coalesce(max(text) FILTER (WHERE attribute = '{t}'), '-') AS {t}" for t in interpret.PROFILE)
REPORT = f"""WITH {_profile_sql()},
texts AS (SELECT claim, attribute, string_agg(label || ' (' || n || '/' || coverage || '; ' || round_even(100.0 * n / greatest(coverage, 1), 0)::INT || '%)', ', ' ORDER BY place) AS text FROM ranked GROUP BY claim, attribute),
wide AS (SELECT claim, {_PIVOT} FROM scored LEFT JOIN texts USING (claim) GROUP BY claim),
best AS (SELECT *, {L.theme_sql('claim')} AS theme FROM scored JOIN wide USING (claim) ORDER BY coverage DESC, support DESC, claim LIMIT 30)
SELECT theme, (row_number() OVER (PARTITION BY theme ORDER BY coverage DESC, support DESC, claim))::INT AS place, claim, coverage::INT AS coverage, support::INT AS support, wisdom_score, {', '.join(interpret.PROFILE)} FROM best QUALIFY place <= 4"""


@query(REPORT)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, meta = _claim_profiles(spark, sf_dir)
    rows = interpret.report_rows(interpret.enrich_clusters(interpret.widest(made, "claim"), meta, "claim"), "claim")
    return rows.select("theme", "place", "claim", "coverage", "support", "wisdom_score", *interpret.PROFILE)


# sizes, correlation, trust


@query(f"WITH {BY_CLAIM} SELECT count(*) AS total_clusters, sum(support)::BIGINT AS total_items, count(*) FILTER (WHERE support = 1) AS singleton_clusters, max(support) AS largest_cluster_size, quantile_cont(support, 0.5) AS median_cluster_size, avg(support) AS mean_cluster_size FROM scored")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.cluster_sizes(claim_rows(spark, sf_dir))


@query(f"WITH {BY_CLAIM}, b AS (SELECT quantile_cont(wisdom_score, 0.8) AS hi, quantile_cont(wisdom_score, 0.2) AS lo FROM scored) SELECT min(wisdom_score) AS least, max(wisdom_score) AS greatest, round(avg(wisdom_score), 6) AS mean_score, count(*) FILTER (WHERE wisdom_score >= hi - 1e-9) AS high_count, count(*) FILTER (WHERE wisdom_score <= lo + 1e-9) AS low_count FROM scored, b")
def quantile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.score_quantiles(claim_clusters(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


_RHO = " UNION ALL ".join(
    f"SELECT '{t}' AS theme, '{p}' AS meta_col, \"{t}\"::DOUBLE AS x, CASE {p} WHEN 'Low' THEN 1 WHEN 'Med' THEN 2 WHEN 'High' THEN 3 END AS y FROM matrix JOIN people_metadata USING (people)" for t in _THEMES for p in diagnostics.PROXIES
)


@query(
    f"""WITH {MATRIX}, long AS ({_RHO}), kept AS (SELECT * FROM long WHERE y IS NOT NULL),
ranked AS (SELECT theme, meta_col, rank() OVER (PARTITION BY theme, meta_col ORDER BY x) + (count(*) OVER (PARTITION BY theme, meta_col, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY theme, meta_col ORDER BY y) + (count(*) OVER (PARTITION BY theme, meta_col, y) - 1) / 2.0 AS ry FROM kept),
rho AS (SELECT theme, meta_col, corr(rx, ry) AS r, count(*) AS sample_size FROM ranked GROUP BY theme, meta_col)
SELECT theme, meta_col, round(r, 6) AS correlation, sample_size FROM rho WHERE sample_size >= 3 AND r IS NOT NULL AND NOT isnan(r)"""
)
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diagnostics.rank_correlations(diagnostics.theme_matrix(claim_clusters(spark, sf_dir)), table(spark, sf_dir, "people_metadata"))
    return made.select("theme", "meta_col", F.round("correlation", 6).alias("correlation"), "sample_size")


@query()
def theme_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-values, which SQL has no function for."""
    return diagnostics.rank_correlations(diagnostics.theme_matrix(claim_clusters(spark, sf_dir)), table(spark, sf_dir, "people_metadata"))


def _embedding_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), F.posexplode("embedding").alias("term", "v"))
    norms = e.groupBy("id").agg(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v"))).alias("norm"))
    return e.join(norms, "id").select("id", "cluster_id", "term", (F.col("v") / F.col("norm")).alias("w"))


_UNIT = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS term FROM embeddings),
u AS (SELECT vec_id, label, term, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS w FROM e)"""


@query(
    f"""{_UNIT}, s AS (SELECT label, term, sum(w) AS s FROM u GROUP BY label, term), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY label), k AS (SELECT label, count(DISTINCT vec_id) AS size FROM u GROUP BY label)
SELECT label AS cluster_id, size, round(1 - (q - size) / (size * (size - 1)), 6) AS distance FROM q JOIN k USING (label) WHERE size >= 2"""
)
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.compactness(_embedding_terms(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(f"""{_UNIT}, s AS (SELECT term, sum(w) AS s FROM u GROUP BY term), n AS (SELECT count(DISTINCT vec_id) AS n FROM u) SELECT n AS n_rows, round((sum(s * s) - n) / (n * (n - 1)), 6) AS mean_similarity FROM s, n GROUP BY n""")
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cut(_embedding_terms(spark, sf_dir))
    n = v.select("id").distinct().count()
    return spark.createDataFrame([(n, tfidf.mean_similarity(v))], "n_rows long, s double").select("n_rows", F.round("s", 6).alias("mean_similarity"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust inputs per family: the share of wide claims stands in for the three quality figures, which have queries of their own."""
    rows = claim_rows(spark, sf_dir).withColumn("family", L.family_of(F.col("people")))
    sizes = rows.groupBy("family", "claim").agg(F.count("*").alias("n"))
    return sizes.groupBy("family").agg(
        (F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0))).alias("silhouette"), F.when(F.count("*") > 5, F.avg(F.when(F.col("n") > 1, 0.0).otherwise(1.0))).alias("compactness"), F.lit(1.0).alias("stability"),
        F.sum("n").alias("total_items"), F.count("*").alias("total_clusters"), F.count_if(F.col("n") == 1).alias("singleton_clusters"), F.max("n").alias("largest_cluster_size"), F.percentile("n", 0.5).alias("median_cluster_size"),
    )


_METRICS = f"""WITH {CLAIMS}, sizes AS (SELECT {L.family_sql('people')} AS family, claim, count(*) AS n FROM long_enough GROUP BY ALL),
metrics AS (SELECT family, avg((n > 1)::INT) AS silhouette, CASE WHEN count(*) > 5 THEN avg((n = 1)::INT) END AS compactness, 1.0 AS stability, sum(n) AS total_items, count(*) AS total_clusters, count(*) FILTER (WHERE n = 1) AS singleton_clusters, max(n) AS largest, quantile_cont(n, 0.5) AS median FROM sizes GROUP BY family),
trusted AS (SELECT *, round(coalesce(least(greatest(8 * silhouette, 0), 4), 0) + coalesce(least(greatest(5 * (0.6 - compactness), 0), 3), 0) + 3 * stability, 1) AS trust_score FROM metrics)"""


@query(f"{_METRICS} SELECT family, trust_score, CASE WHEN trust_score >= 7 THEN 'High' WHEN trust_score >= 4 THEN 'Medium' ELSE 'Low' END AS trust_band, CASE WHEN total_items >= 100 THEN 'Good' ELSE 'Limited' END AS data_quality FROM trusted")
def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.trust_report(_metrics(spark, sf_dir)).select("family", "trust_score", "trust_band", "data_quality")


@query(
    f"""{_METRICS}, codes AS (
SELECT 'silhouette_low' AS code, 'High' AS priority FROM metrics WHERE silhouette < 0.15 UNION ALL SELECT 'many_singletons', 'Medium' FROM metrics WHERE singleton_clusters / total_clusters > 0.5
UNION ALL SELECT 'few_items', 'Medium' FROM metrics WHERE total_items < 100 UNION ALL SELECT 'one_sided', 'Low' FROM metrics WHERE largest > 10 * median UNION ALL SELECT 'no_correlation', 'Low' FROM metrics)
SELECT code, priority, count(*) AS n FROM codes GROUP BY code, priority"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.recommendations(_metrics(spark, sf_dir), F.lit(0)).groupBy("code", "priority").agg(F.count("*").alias("n"))


_TOP = "SELECT claim FROM (SELECT claim, count(*) AS n FROM items GROUP BY claim) ORDER BY n DESC, claim LIMIT 5"


@query(
    f"""WITH trials AS (SELECT * FROM (VALUES ('0.8', 0.8), ('0.9', 0.9), ('0.95', 0.95)) t(name, ratio), (VALUES (0), (1), (2)) d(draw)),
drawn AS (SELECT ratio, draw, claim FROM items, trials QUALIFY row_number() OVER (PARTITION BY ratio, draw ORDER BY md5('0/' || draw || '/' || name || '/' || ord), ord) <= floor((SELECT count(*) FROM items) * ratio + 1e-9)),
counted AS (SELECT ratio, draw, claim, count(*) AS n FROM drawn GROUP BY ALL),
best AS (SELECT ratio, draw, claim FROM counted QUALIFY row_number() OVER (PARTITION BY ratio, draw ORDER BY n DESC, claim) <= 5)
SELECT ratio::DOUBLE AS ratio, draw, count(*) FILTER (WHERE claim IN ({_TOP})) / 5.0::DOUBLE AS kept FROM best GROUP BY ratio, draw"""
)
def topk_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.stability(table(spark, sf_dir, "items"), "ord", "claim")


# ratings


@query("SELECT ord, rating_id, coherence, quality, remark, rated_at FROM ratings QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rated_at DESC, rating_id DESC) = 1")
def rating_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.latest_ratings(table(spark, sf_dir, "ratings"), "ord", "rated_at", "rating_id").select("ord", "rating_id", "coherence", "quality", "remark", "rated_at")


@query(
    f"""WITH latest AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rated_at DESC, rating_id DESC) = 1),
s AS (SELECT {L.scale_sql('coherence', L.COHERENCE)} AS c, {L.scale_sql('quality', L.QUALITY)} AS q, coalesce(trim(remark), '') AS r FROM latest),
a AS (SELECT count(*) AS n_ratings, avg(c) AS avg_coherence, avg(q) AS avg_quality, count(*) FILTER (WHERE c <= 2) AS problem_clusters, count(*) FILTER (WHERE r <> '') AS n_remarks FROM s)
SELECT *, CASE WHEN avg_coherence >= 4 THEN 'High' WHEN avg_coherence >= 3 THEN 'Moderate' ELSE 'Low' END AS coherence_band, CASE WHEN avg_quality >= 3 THEN 'Good' WHEN avg_quality >= 2 THEN 'Fair' ELSE 'Poor' END AS quality_band,
CASE WHEN avg_coherence >= 3.5 AND avg_quality >= 2.5 THEN 'good' WHEN avg_coherence >= 2.5 OR avg_quality >= 2 THEN 'mixed' ELSE 'poor' END AS verdict FROM a"""
)
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rating_summary(validation.latest_ratings(table(spark, sf_dir, "ratings"), "ord", "rated_at", "rating_id"), "remark")


@query("SELECT (epoch_us(max(rated_at)) - epoch_us(min(rated_at))) / 1e6 AS seconds FROM ratings")
def rating_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rating_span(table(spark, sf_dir, "ratings"))


_FIELDS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || {t} END"
    for c, t in (("coherence", "to_json(coherence)::VARCHAR"), ("ord", "ord"), ("quality", "to_json(quality)::VARCHAR"), ("rated_at", "strftime(rated_at, '\"%Y-%m-%dT%H:%M:%S.%f\"')"), ("rating_id", "rating_id"), ("remark", "to_json(remark)::VARCHAR"))
)


@query(f"SELECT '{{' || array_to_string([{_FIELDS}], ',') || '}}' AS json FROM ratings")
def rating_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.export_ratings(table(spark, sf_dir, "ratings"))


@query(f"WITH {BY_CLAIM}, best AS (SELECT claim FROM scored ORDER BY wisdom_score DESC, claim LIMIT 5), drawn AS (SELECT claim FROM scored WHERE claim NOT IN (SELECT claim FROM best) ORDER BY md5('0/' || claim), claim LIMIT 5) SELECT claim, 'top' AS part FROM best UNION ALL SELECT claim, 'drawn' FROM drawn")
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_sample(claim_clusters(spark, sf_dir), "claim").select("claim", "part")


# sources


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").withColumnRenamed("source_type", "type")


@query("SELECT 'people' AS kind, people AS name, count(*) AS n FROM sources GROUP BY people UNION ALL SELECT 'type', coalesce(source_type, 'wikiquote'), count(*) FROM sources GROUP BY 2")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    return s.groupBy(F.lit("people").alias("kind"), F.col("people").alias("name")).agg(F.count("*").alias("n")).union(s.groupBy(F.lit("type"), F.coalesce("type", F.lit("wikiquote"))).agg(F.count("*")))


_MAJORS = ", ".join(repr(m) for m in clean.MAJOR_PEOPLES)


@query(f"SELECT source_type AS type, people, url FROM sources WHERE people IN ({_MAJORS}) AND coalesce(source_type, 'wikiquote') IN ('wikiquote', 'gutenberg_html')")
def source_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.select_sources(_sources(spark, sf_dir), clean.MAJOR_PEOPLES, ("wikiquote", "gutenberg_html")).select("type", "people", "url")


@query(
    f"""WITH p AS (SELECT DISTINCT people, people IN ({_MAJORS}) AS major FROM sources WHERE people IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY major ORDER BY people) AS r FROM p),
first AS (SELECT * FROM r WHERE major AND r <= 5 // 2), rest AS (SELECT * FROM r WHERE NOT major AND r <= 5 - (SELECT count(*) FROM first))
SELECT people, (row_number() OVER (ORDER BY NOT major, r))::INT AS place FROM (SELECT * FROM first UNION ALL SELECT * FROM rest)"""
)
def source_default_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.default_people(_sources(spark, sf_dir))


@query("SELECT s.source_type AS type, s.people, s.url, count(r.row_id) AS n_rows FROM sources s LEFT JOIN sayings_raw r ON r.source_url = s.url GROUP BY ALL")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sayings(spark, sf_dir).where("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n_rows"))
    return _sources(spark, sf_dir).join(counted, "url", "left").na.fill(0, ["n_rows"]).select("type", "people", "url", "n_rows")


@query("SELECT people, count(*) AS n, count(saying) AS n_sayings, count(english_equivalent) AS n_equivalents FROM (SELECT people, saying, english_equivalent FROM sayings_raw UNION ALL SELECT people, saying, NULL FROM items) GROUP BY people")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = clean.union_sayings([sayings(spark, sf_dir).select("people", "saying", "english_equivalent"), table(spark, sf_dir, "items").select("people", "saying")])
    return both.groupBy("people").agg(F.count("*").alias("n"), F.count("saying").alias("n_sayings"), F.count("english_equivalent").alias("n_equivalents"))


_LINES = f"""lines AS (SELECT page_id AS id, unnest(string_split(saying, chr(10))) AS raw, generate_subscripts(string_split(saying, chr(10)), 1) - 1 AS place FROM page_captures),
trimmed AS (SELECT id, place::INT AS place, {trim_sql('raw')} AS item FROM lines)"""


@query(f"WITH {_LINES} SELECT id, place, item FROM trimmed WHERE item <> '' AND {words_sql('item')} BETWEEN 3 AND 20 AND NOT ({hit('item', P.whole_words(pages.BOOK_FURNITURE))} OR {hit('item', pages.LONDON_TRAP)}) AND {hit('item', X.SENTENCE_MARK)} QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 5000")
def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.line_items(table(spark, sf_dir, "page_captures"), "page_id", "saying", pages.book_rule)


@query(f"WITH {_LINES} SELECT id, place, item FROM trimmed WHERE item <> '' AND {words_sql('item')} > 3 AND {hit('item', X.SENTENCE_MARK)} QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 5000")
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.line_items(table(spark, sf_dir, "page_captures"), "page_id", "saying", pages.archive_rule)


# vectors and clusters


_GRAM = """words AS (SELECT ord, ' ' || w || ' ' AS w FROM (SELECT ord, unnest(string_split_regex(lower(claim), '\\s+')) AS w FROM items) WHERE w <> ''),
grams AS (SELECT ord, w AS term FROM words WHERE length(w) <= 3 UNION ALL SELECT ord, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) FROM words, (VALUES (3), (4), (5), (6)) t(n) WHERE length(w) > n OR (length(w) = n AND n > 3)),
tf AS (SELECT ord, term, count(*) AS tf FROM grams GROUP BY ALL), n AS (SELECT count(*) AS n FROM items),
terms AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) <= 0.9 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 5000),
raw AS (SELECT ord, term, tf * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN terms USING (term))"""


@query(f"WITH {_GRAM} SELECT ord AS id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY ord)), 6) AS w FROM raw")
def ngram_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.tfidf(table(spark, sf_dir, "items"), "ord", "claim", tfidf.CLUSTERING).withColumn("w", F.round("w", 6))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_first(table(spark, sf_dir, "items").select("ord", "claim"), ["claim"], "ord")


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the distinct claims' reduced wording; equal texts stand for each other."""
    return cut(tfidf.tfidf(_items(spark, sf_dir).withColumn("processed", C.reduce_wording(F.col("claim"))), "ord", "processed", tfidf.CLUSTERING))


def _item_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors in blocks, in a tenth of the room."""
    return tfidf.packed_tfidf(_items(spark, sf_dir).withColumn("processed", C.reduce_wording(F.col("claim"))), "ord", "processed", tfidf.CLUSTERING)


def _item_threshold(spark: SparkSession, sf_dir: str) -> float:
    """The threshold the engine would use for the distinct claims."""
    return tfidf.used_threshold(_items(spark, sf_dir), "ord", "claim")


@query()
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.similar_pairs(_item_vectors(spark, sf_dir), 1.0 - _item_threshold(spark, sf_dir))


@query()
def hac_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage of the distinct claims at the adaptive threshold."""
    v = _item_vectors(spark, sf_dir)
    return linkage.cluster_vectors(v, v.select("id").distinct(), _item_threshold(spark, sf_dir))


@query()
def sayings_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustering pipeline of the engine: each claim's cluster."""
    return engine.cluster_sayings(sayings(spark, sf_dir))[1].select("row_id", "claim", "cluster_id")


@query()
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _item_vectors(spark, sf_dir)
    return experiments.threshold_sweep(v, v.select("id").distinct(), (0.25, 0.3, 0.35, 0.4, 0.45))


@query()
def bootstrap_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the clustering at the adaptive threshold with those of subsamples."""
    v = _item_vectors(spark, sf_dir)
    return experiments.bootstrap_agreement(v, v.select("id").distinct(), _item_threshold(spark, sf_dir))


@query()
def cophenetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(experiments.sample_cophenetic(_item_vectors(spark, sf_dir)),)], "cophenetic double")


@query()
def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = clean.keep_first(table(spark, sf_dir, "items").select("ord", "claim"), ["claim"], "ord")
    return embed.coordinates(items, "ord", "claim")


@query(
    "WITH l AS (SELECT a.label AS x, b.label AS y, count(*) AS n FROM embeddings a JOIN embeddings b USING (vec_id) GROUP BY ALL), o AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM l), x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM l GROUP BY x)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM l GROUP BY y)) "
    "SELECT CASE WHEN (x.v + y.v) / 2 = x.v * y.v / (t * (t - 1) / 2) THEN 1.0 ELSE (o.v - x.v * y.v / (t * (t - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (t * (t - 1) / 2)) END AS adjusted_rand FROM o, x, y"
)
def rand_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    return experiments.rand_index(a, a)


@query()
def threshold_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the clusterings at the least and the greatest threshold of the sweep."""
    v = _item_vectors(spark, sf_dir)
    ids = v.select("id").distinct()
    merges = linkage.merge_tree(v, 0.45)
    return experiments.rand_index(linkage.cluster_vectors(v, ids, 0.25, merges=merges), linkage.cluster_vectors(v, ids, 0.45, merges=merges))


@query()
def mixing_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How mixed the peoples of each cluster of claims are, against random draws; equal claims share their first row's cluster."""
    items = table(spark, sf_dir, "items").where("people is not null").select("ord", "people", "claim")
    firsts = _items(spark, sf_dir).select(F.col("ord").alias("id"), "claim")
    labels = linkage.cluster_vectors(_item_blocks(spark, sf_dir), firsts.select("id"), _item_threshold(spark, sf_dir))
    members = cut(items.join(firsts.join(labels, "id"), "claim").select("ord", "people", "cluster_id"))
    return experiments.mixing_baseline(members, "people", id_col="ord")


@query("WITH s AS (SELECT row_id, people, row_number() OVER (PARTITION BY people ORDER BY md5('0/' || row_id), row_id) AS place, count(*) OVER (PARTITION BY people) AS size FROM sayings_raw) SELECT row_id, people FROM s WHERE place <= ceil(size * 0.2 - 1e-9)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.stratified_sample(sayings(spark, sf_dir).select("row_id", "people"), "people", "row_id", 0.2)


@query("SELECT row_id, people, NULL::VARCHAR AS meaning_preserved, NULL::VARCHAR AS notes FROM sayings_raw ORDER BY md5('0/' || row_id), row_id LIMIT 400")
def audit_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.audit_sheet(sayings(spark, sf_dir).select("row_id", "people"), "row_id")


# streams


@query(f"WITH {BASIS} SELECT count(*) AS n_rows, sum({SCORE_SQL})::BIGINT AS score, count(DISTINCT {C.canonical_sql('basis')}) AS n_claims FROM based WHERE {KEEP_SQL}")
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning expressions on a file stream, one pass over what is there."""
    schema = sayings(spark, sf_dir).schema
    stream = live.clean_stream(live.stream_table(spark, f"{sf_dir}/sayings_raw.parquet*", schema))
    out = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.select("quality_score", "claim").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").agg(F.count("*").alias("n_rows"), F.sum("quality_score").alias("score"), F.count_distinct("claim").alias("n_claims"))
