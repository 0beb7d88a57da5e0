"""Queries on readers, writers and extractors: whole tables go out to files in the shared folder, or into pages, and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parolith import engine
from parolith.functions import patterns as P
from parolith.functions import text as X
from parolith.operators import clean, clusters, interpret, linkage, validation
from parolith.plans.catalog import BY_CLAIM, CLEAN, REPORT, _LINES, claim_clusters, hit, query, sayings, trim_sql, words_sql
from parolith.schemas import SAYINGS
from parolith.session import cut, ensure_checkpoint_dir, table
from parolith.sources import files, pages


def _place(spark: SparkSession, ending: str = "") -> str:
    return f"{ensure_checkpoint_dir(spark)}/file-{uuid.uuid4().hex}{ending}"


# readers and writers

_COLUMNS = ", ".join(f"nullif({f.name}, '') AS {f.name}" for f in SAYINGS)


@query(f"SELECT {_COLUMNS} FROM sayings_raw")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sayings written as CSV and read by column name; line feeds and quotes inside a field survive, and an empty field is null."""
    path = _place(spark)
    files.write_csv(sayings(spark, sf_dir).select(*[f.name for f in SAYINGS]), path)
    return files.read_csv(spark, path)


@query("SELECT people, count(*) AS n_rows, count(saying) AS n_sayings, 1 AS n_failed FROM (SELECT nullif(people, '') AS people, nullif(saying, '') AS saying FROM sayings_raw UNION ALL SELECT nullif(people, ''), nullif(saying, '') FROM items) GROUP BY people")
def csv_scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV folders of different columns, and one that isn't there, which is reported and left out."""
    one, two = _place(spark), _place(spark)
    files.write_csv(sayings(spark, sf_dir).drop("ingested_at"), one)
    files.write_csv(table(spark, sf_dir, "items"), two)
    both, failed = files.read_many_csv(spark, [one, _place(spark), two])
    return both.groupBy("people").agg(F.count("*").alias("n_rows"), F.count("saying").alias("n_sayings"), F.lit(len(failed)).alias("n_failed"))


@query("SELECT * FROM people_metadata")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_csv(table(spark, sf_dir, "people_metadata"), path)
    return files.read_metadata(spark, path)


@query("SELECT coalesce(nullif(source_type, ''), 'wikiquote') AS type, people, url FROM sources")
def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as a YAML list and read back; a record without a type is a wikiquote page."""
    import yaml

    path = _place(spark, ".yaml")
    rows = table(spark, sf_dir, "sources").limit(100_001).collect()  # a catalogue, not data
    files.write_text(spark, yaml.safe_dump([{k: v for k, v in (("type", r["source_type"]), ("people", r["people"]), ("url", r["url"])) if v is not None} for r in rows], allow_unicode=True), path)
    return files.read_sources(spark, path)


@query("SELECT source_type AS type, people, url FROM sources")
def per_source_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_per_source(table(spark, sf_dir, "sources").withColumnRenamed("source_type", "type"), path)
    return spark.read.parquet(path).select(F.col("type").cast("string").alias("type"), F.col("people").cast("string").alias("people"), "url")


@query(f"WITH {CLEAN} SELECT nullif(people, '') AS people, nullif(filled, '') AS original, nullif(saying, '') AS saying FROM clean")
def clean_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_csv(clean.clean_sayings(sayings(spark, sf_dir)).drop("ingested_at"), path)
    return files.read_csv(spark, path).select("people", "original", "saying")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal claims, numbered by claim."""
    made = cut(claim_clusters(spark, sf_dir))
    numbers = linkage.number_clusters(made.select(F.col("claim").alias("id"), F.col("claim").alias("first")))
    return made.join(numbers.withColumnRenamed("id", "claim"), "claim")


_CLUSTERS = f"""WITH {BY_CLAIM} SELECT (row_number() OVER (ORDER BY encode(claim)) - 1)::INT AS cluster_id, claim, coverage::INT AS coverage, support::INT AS support, array_to_string(cultures, '|') AS cultures, families::INT AS family_diversity FROM scored"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("cluster_id", "claim", "coverage", "support", F.array_join("cultures", "|").alias("cultures"), "family_diversity")


@query(_CLUSTERS)
def clusters_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written as Parquet and read again."""
    path = _place(spark)
    files.write_clusters(_numbered(spark, sf_dir), path)
    return _flat(files.read_clusters(spark, path))


@query(_CLUSTERS)
def clusters_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written as one JSON array and read again."""
    path = _place(spark, ".json")
    files.write_json_array(_numbered(spark, sf_dir), path)
    return _flat(files.read_clusters(spark, path))


@query(f"WITH {BY_CLAIM} SELECT people, count(*) AS n_claims FROM (SELECT unnest(cultures) AS people FROM scored) GROUP BY people")
def nested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that a CSV holds as JSON text, decoded."""
    path = _place(spark)
    files.write_csv(claim_clusters(spark, sf_dir).select("claim", "cultures"), path)
    cells = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return cells.select(F.explode(files.decode_list(F.col("cultures"))).alias("people")).groupBy("people").agg(F.count("*").alias("n_claims"))


@query(f"WITH c AS ({_CLUSTERS}) SELECT cluster_id, claim, coverage, support, family_diversity, true AS placed FROM c")
def coords_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates written as CSV, read again and joined with their clusters by id."""
    made = cut(_numbered(spark, sf_dir))
    path = _place(spark)
    files.write_csv(engine.cluster_coordinates(made), path)
    read = files.read_coords(spark, path).select("cluster_id", "x", "y")
    joined = made.join(read, "cluster_id")
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return joined.select("cluster_id", "claim", "coverage", "support", "family_diversity", finite.alias("placed"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = interpret.enrich_clusters(interpret.widest(claim_clusters(spark, sf_dir), "claim"), table(spark, sf_dir, "people_metadata"), "claim")
    return cut(interpret.report_rows(enriched, "claim"))


@query(REPORT)
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report and, beside it, the enriched clusters, read again from there."""
    rows = _report(spark, sf_dir).select("theme", "place", "claim", "coverage", "support", "wisdom_score", *interpret.PROFILE)
    _, beside = files.write_report(interpret.report_text(rows), rows, _place(spark, ".txt"))
    return spark.read.schema(rows.schema).option("multiLine", True).json(beside)


_BLOCK = """'- **Claim:** ' || claim || chr(10) || '  - Coverage: ' || coverage || ' peoples; Support: ' || support || ' instances; Wisdom score: ' || wisdom_score::DOUBLE || chr(10)
 || '  - Regions/Families/Climates: ' || t_regions || ' / ' || t_families || ' / ' || t_climates || chr(10) || '  - Coastal/Island/Maritime: ' || t_coastal || ' / ' || t_island || ' / ' || t_maritime || chr(10)
 || '  - Trade/Migration: ' || t_trade || ' / ' || t_migration || chr(10) || '  - Subsistence/Staple: ' || t_subsistence || ' / ' || t_staple || chr(10)
 || '  - Legal/Urban: ' || t_legal || ' / ' || t_urban || chr(10) || '  - Individualism/Uncertainty: ' || t_indiv || ' / ' || t_uncert"""


@query(f"SELECT theme, place, {_BLOCK} AS block FROM ({REPORT})")
def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim of the report (at most 30) as its block of text."""
    rows = _report(spark, sf_dir).orderBy("theme_no", "place").collect()
    return spark.createDataFrame([(r["theme"], r["place"], interpret.claim_block(r)) for r in rows], "theme string, place int, block string")


_REPORT_LINES = f"""WITH r AS ({REPORT}), b AS (SELECT theme, place, {_BLOCK} AS block FROM r), t AS (SELECT theme, '## ' || theme || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) AS part FROM b GROUP BY theme)
SELECT count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS n_blank, count(*) FILTER (WHERE line LIKE '## %') AS n_themes, count(*) FILTER (WHERE line LIKE '- **Claim:**%') AS n_claims
FROM (SELECT unnest(string_split(part, chr(10))) AS line FROM t UNION ALL SELECT '' FROM range((SELECT count(*) FROM t)) UNION ALL SELECT 'title' UNION ALL SELECT '' UNION ALL SELECT 'note')"""


@query(_REPORT_LINES)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is given of the report: its first 400 lines, counted by kind."""
    path = _place(spark, ".txt")
    files.write_text(spark, interpret.report_text(_report(spark, sf_dir)), path)
    lines = interpret.first_lines(files.read_text(spark, path)).split("\n")
    return spark.createDataFrame([(len(lines), lines.count(""), sum(x.startswith("## ") for x in lines), sum(x.startswith("- **Claim:**") for x in lines))], "n_lines long, n_blank long, n_themes long, n_claims long")


@query("SELECT ord, rating_id, coherence, quality, remark FROM ratings QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rated_at DESC, rating_id DESC) = 1")
def ratings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and newest ratings in one JSON file; the ratings as read from it."""
    newest = cut(validation.latest_ratings(table(spark, sf_dir, "ratings"), "ord", "rated_at", "rating_id"))
    path = _place(spark, ".json")
    files.write_ratings(newest, validation.rating_summary(newest, "remark"), path)
    shape = "summary struct<n_ratings: long>, ratings array<struct<ord: long, rating_id: long, coherence: string, quality: string, remark: string>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.inline("ratings"))


@query("SELECT 0::BIGINT AS clusters, 0::BIGINT AS coords, 11 AS columns, 8 AS coord_columns")
def absent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't there are read as typed tables without rows."""
    c, x = files.read_clusters(spark, _place(spark)), files.read_coords(spark, _place(spark))
    return c.agg(F.count("*").alias("clusters")).crossJoin(x.agg(F.count("*").alias("coords"))).select("*", F.lit(len(c.columns)).alias("columns"), F.lit(len(x.columns)).alias("coord_columns"))  # one row each


# extractors

def _escaped() -> Column:
    return F.replace(F.replace(F.replace("saying", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(spark: SparkSession, sf_dir: str, before: str, between: tuple[str, str], after: str) -> DataFrame:
    """The captured pages, each line written as an element of an HTML page."""
    body = F.concat(F.lit(before + between[0]), F.replace(_escaped(), F.lit("\n"), F.lit(between[1] + between[0])), F.lit(between[1] + after))
    return table(spark, sf_dir, "page_captures").select(F.col("source_url").alias("url"), "people", body.alias("html"))


_TOP = '<html><body><ul><li>Some menu item.</li></ul><div id="mw-content-text"><div class="mw-parser-output"><h2><span class="mw-headline" id="Sayings">Sayings</span></h2><ul>'
_END = '</ul><h2><span class="mw-headline" id="References">References</span></h2><ul><li>A line below the references, for all pages.</li></ul></div></div></body></html>'
_ITEMS = f"""{_LINES}, items AS (SELECT id, place, item FROM trimmed WHERE item <> ''), urls AS (SELECT page_id AS id, source_url AS url, people FROM page_captures)"""
_QUOTE = f"NOT {hit('item', P.whole_words(pages.QUOTE_FURNITURE))} AND NOT {hit('item', X.CATEGORY_TRAP)} AND NOT {hit('item', X.BIBLIOGRAPHIC)} AND {words_sql('item')} >= 3"
_APPENDIX = f"NOT {hit('item', P.whole_words(pages.APPENDIX_FURNITURE))} AND {words_sql('item')} >= 3"
_BOOK = f"{words_sql('item')} BETWEEN 3 AND 20 AND NOT ({hit('item', P.whole_words(pages.BOOK_FURNITURE))} OR {hit('item', pages.LONDON_TRAP)}) AND {hit('item', X.SENTENCE_MARK)}"
_ARCHIVE = f"{words_sql('item')} > 3 AND {hit('item', X.SENTENCE_MARK)}"


@query(f"WITH {_ITEMS} SELECT url, item, min(place)::INT AS place FROM items JOIN urls USING (id) WHERE {_QUOTE} GROUP BY url, item")
def wikiquote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the content part, the first of equal ones; the menu above it and what stands below the references are left out."""
    made = pages.EXTRACTORS["wikiquote"][0](_pages(spark, sf_dir, _TOP, ("<li>", "</li>"), _END))
    return made.select("url", "item", "place")


@query(f"WITH {_ITEMS} SELECT url, people, item FROM items JOIN urls USING (id)")
def category_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled links of the category list; links outside it and without a title are none."""
    html = _pages(spark, sf_dir, '<ul><li><a title="x">Not in the list.</a></li></ul><div id="mw-pages"><ul><li><a>untitled</a></li>', ('<li><a title="t">', "</a></li>"), "</ul></div>")
    return pages.EXTRACTORS["wiktionary_category"][0](html).select("url", "people", "item")


@query(f"WITH {_ITEMS} SELECT url, people, item FROM items JOIN urls USING (id) WHERE {_APPENDIX} UNION ALL SELECT source_url, people, 'A line below the references, for all pages.' FROM page_captures")
def appendix_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the content part, repeated ones too; no part of it is passed over."""
    return pages.EXTRACTORS["wiktionary_appendix"][0](_pages(spark, sf_dir, _TOP, ("<li>", "</li>"), _END)).select("url", "people", "item")


@query(f"WITH {_ITEMS} SELECT url, people, item FROM items JOIN urls USING (id) WHERE {_BOOK} QUALIFY row_number() OVER (PARTITION BY url ORDER BY place) <= 5000")
def book_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a book's page; script and style are no text."""
    html = _pages(spark, sf_dir, "<html><head><style>A style; it is no text.</style></head><body><script>var a = 1; // a script is no text.</script>", ("<p>", "</p>"), "</body></html>")
    return pages.EXTRACTORS["gutenberg_html"][0](html).select("url", "people", "item")


@query(f"WITH {_ITEMS} SELECT url, people, item FROM items JOIN urls USING (id) WHERE {_ARCHIVE} QUALIFY row_number() OVER (PARTITION BY url ORDER BY place) <= 5000")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an archive's page."""
    return pages.EXTRACTORS["internet_archive_html"][0](_pages(spark, sf_dir, "<ul>", ("<li>", "</li>"), "</ul>")).select("url", "people", "item")


#: The kind of each captured page by the length of its address, among them an unknown one and none.
_KINDS = ("wikiquote", "wiktionary_category", "wiktionary_appendix", "gutenberg_html", "internet_archive_html", "rss", None)
_KIND_SQL = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k in _KINDS) + f"][1 + length(source_url) % {len(_KINDS)}]"


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, pages): pages without a people were not fetched."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.length("source_url") % len(_KINDS) + 1)
    captured = table(spark, sf_dir, "page_captures")
    sources = captured.select(kind.alias("type"), F.coalesce("people", F.lit("World")).alias("people"), F.col("source_url").alias("url"))
    html = _pages(spark, sf_dir, '<div id="mw-pages"><div id="mw-content-text"><div class="mw-parser-output"><ul>', ('<li><a title="t">', "</a></li>"), "</ul></div></div></div>")
    return sources, html.where("people is not null").select("url", "html")


_BUILT = f"""WITH {_ITEMS}, typed AS (SELECT source_url AS url, people, coalesce({_KIND_SQL}, 'wikiquote') AS type FROM page_captures WHERE people IS NOT NULL),
found AS (SELECT DISTINCT ON (type = 'wikiquote', url, CASE WHEN type = 'wikiquote' THEN item ELSE id || '/' || place END) t.type, t.url, t.people, item FROM items JOIN urls u USING (id) JOIN typed t USING (url)
  WHERE CASE type WHEN 'wikiquote' THEN {_QUOTE} WHEN 'wiktionary_category' THEN true WHEN 'wiktionary_appendix' THEN {_APPENDIX} WHEN 'gutenberg_html' THEN {_BOOK} WHEN 'internet_archive_html' THEN {_ARCHIVE} END)
SELECT people, item AS original, item AS saying, '' AS english_equivalent,
  CASE type WHEN 'wikiquote' THEN 'Wikiquote' WHEN 'wiktionary_category' THEN 'Wiktionary Category' WHEN 'wiktionary_appendix' THEN 'Wiktionary Appendix' WHEN 'gutenberg_html' THEN 'Gutenberg' ELSE 'InternetArchive' END || ': ' || people AS source_title,
  url AS source_url, '2024-01-31' AS accessed FROM found"""


@query(_BUILT)
def built_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of five kinds of page and the pages fetched for it, as rows of the sayings table."""
    return pages.build_from_pages(*_catalogue(spark, sf_dir), "2024-01-31")[0]


@query(f"SELECT coalesce({_KIND_SQL}, 'wikiquote') AS type, coalesce(people, 'World') AS people, source_url AS url, CASE WHEN {_KIND_SQL} = 'rss' THEN 'unknown type' ELSE 'not fetched' END AS reason FROM page_captures WHERE people IS NULL OR {_KIND_SQL} = 'rss'")
def skipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.build_from_pages(*_catalogue(spark, sf_dir), "2024-01-31")[1]


# stages of cleaning


@query(f"WITH {CLEAN.replace('FROM sayings_raw', 'FROM (SELECT row_id, people, saying, NULL AS original, NULL AS english_equivalent FROM sayings_raw)')} SELECT row_id, people, basis, filled AS original FROM clean")
def clean_few_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent columns are filled: no equivalent, and the saying for the original."""
    return clean.clean_sayings(sayings(spark, sf_dir).select("row_id", "people", "saying")).select("row_id", "people", "basis", "original")


@query(
    f"WITH {CLEAN}, t AS (SELECT *, basis AS t0, {trim_sql('basis')} AS tt FROM clean), "
    f"f AS (SELECT *, (tt = '' OR {hit('tt', X.BIBLIOGRAPHIC)} OR {hit('tt', X.FILTER_BAD)} OR ({hit('tt', X.CITATION_YEAR)} AND {hit('tt', X.CITATION_NEXT)}) OR ({words_sql('t0')} > 40 AND NOT {hit('tt', X.SENTENCE_MARK)})) AS bibliography, "
    f"({hit('t0', X.SENTENCE_MARK)} OR {hit('t0', P.whole_words(X.FILTER_CUES))} OR {hit('t0', '(?i)^(?:' + '|'.join(X.FILTER_OPENERS) + ')(?:$|[^' + P.W + '])')}) AS cues FROM t) SELECT row_id, people, basis FROM f WHERE NOT bibliography AND cues"
)
def merge_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging and cleaning with the optional row filter on."""
    return clean.merge_and_clean([sayings(spark, sf_dir)], filter_rows=True)[1].select("row_id", "people", "basis")


@query("SELECT count(*) AS n_rows, count(DISTINCT people) AS n_peoples FROM sayings_raw WHERE people IS NOT NULL AND saying IS NOT NULL")
def culture_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.culture_count(sayings(spark, sf_dir).na.drop(subset=["people", "saying"]))
