"""Clusters with the metadata of their peoples, and the themed report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions.labels import REPORT_THEMES, theme_of
from parolith.session import cut

#: Report column -> metadata column.
PROFILE = {
    "t_regions": "region", "t_families": "language_family", "t_climates": "climate_zone", "t_coastal": "coastal", "t_island": "is_island", "t_maritime": "maritime_orientation",
    "t_trade": "trade_route_proximity", "t_migration": "migration_hub", "t_subsistence": "subsistence_bias", "t_staple": "staple_crop", "t_legal": "legal_origin",
    "t_urban": "urbanization_level", "t_indiv": "individualism_proxy", "t_uncert": "uncertainty_avoidance_proxy",
}
REQUIRED = ("region", "language_family", "climate_zone")


def profile_counts(clusters: DataFrame, metadata: DataFrame, cluster: str = "cluster_id", top: int = 3) -> DataFrame:
    """(cluster, attribute, label, n, place): the most frequent values among the cluster's peoples; ties by the first people that has it.

    Peoples match without regard to case. A metadata column that isn't there counts as "?", null values as "None".
    """
    absent = [c for c in PROFILE.values() if c not in metadata.columns]
    if any(c in REQUIRED for c in absent):
        raise ValueError(f"metadata lacks {', '.join(c for c in absent if c in REQUIRED)}")
    meta = metadata.withColumns({c: F.lit("?") for c in absent}) if absent else metadata
    meta = meta.select(F.lower("people").alias("key"), *[F.coalesce(F.col(c), F.lit("None")).alias(c) for c in PROFILE.values()])
    peoples = clusters.select(cluster, F.posexplode("cultures").alias("place", "people")).withColumn("key", F.lower("people"))
    wide = peoples.join(meta, "key")
    long = wide.select(cluster, "place", F.explode(F.array(*[F.struct(F.lit(t).alias("attribute"), F.col(c).alias("label")) for t, c in PROFILE.items()])).alias("x"))
    counted = long.groupBy(cluster, "x.attribute", "x.label").agg(F.count("*").cast("int").alias("n"), F.min("place").alias("first"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy(cluster, "attribute").orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("place") <= top).select(cluster, "attribute", "label", "n", "place")


def enrich_clusters(clusters: DataFrame, metadata: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The clusters with theme and 14 profile texts such as ``Region (1/3; 33%)``; "-" without a match. Percentages are of coverage."""
    clusters = cut(clusters)
    counts = profile_counts(clusters, metadata, cluster).join(clusters.select(cluster, "coverage"), cluster)
    percent = F.bround(100.0 * F.col("n") / F.greatest(F.col("coverage"), F.lit(1)), 0).cast("int")
    with_share = F.format_string("%s (%d/%d; %d%%)", "label", "n", "coverage", percent)
    text = F.when(F.col("coverage") == 0, F.format_string("%s (%d)", "label", "n")).otherwise(with_share)
    listed = counts.withColumn("text", text).groupBy(cluster, "attribute").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), ", ").alias("text"))
    wide = listed.groupBy(cluster).pivot("attribute", list(PROFILE)).agg(F.first("text"))
    full = clusters.join(wide, cluster, "left").na.fill("-", list(PROFILE))
    return full.withColumn("theme", theme_of(F.col("claim")))


def widest(clusters: DataFrame, cluster: str = "cluster_id", top: int = 30) -> DataFrame:
    """The clusters a report looks at; taken before they are joined with metadata, for the report needs no others."""
    return clusters.orderBy(F.desc("coverage"), F.desc("support"), cluster).limit(top)


def report_rows(enriched: DataFrame, cluster: str = "cluster_id", top: int = 30, per_theme: int = 4) -> DataFrame:
    """(theme_no, place, cluster, ...): of the 30 widest clusters, the first four of each theme."""
    best = widest(enriched, cluster, top)
    names = [n for n, _ in REPORT_THEMES] + ["Other"]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("theme")).cast("int")
    placed = best.withColumn("theme_no", number).withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("coverage"), F.desc("support"), cluster)))
    return placed.where(F.col("place") <= per_theme).orderBy("theme_no", "place")


def claim_block(row) -> str:
    return "\n".join([
        f"- **Claim:** {row['claim']}",
        f"  - Coverage: {row['coverage']} peoples; Support: {row['support']} instances; Wisdom score: {row['wisdom_score']}",
        f"  - Regions/Families/Climates: {row['t_regions']} / {row['t_families']} / {row['t_climates']}",
        f"  - Coastal/Island/Maritime: {row['t_coastal']} / {row['t_island']} / {row['t_maritime']}",
        f"  - Trade/Migration: {row['t_trade']} / {row['t_migration']}",
        f"  - Subsistence/Staple: {row['t_subsistence']} / {row['t_staple']}",
        f"  - Legal/Urban: {row['t_legal']} / {row['t_urban']}",
        f"  - Individualism/Uncertainty: {row['t_indiv']} / {row['t_uncert']}",
    ])


def report_text(rows: DataFrame, title: str = "Claims across cultures") -> str:
    """The report of at most 30 rows as markdown."""
    parts, theme = [f"# {title}", "Coverage counts distinct peoples; `Label (1/3; 33%)` says that one of three covered peoples has the label."], None
    for row in rows.collect():
        if row["theme"] != theme:
            theme = row["theme"]
            parts.append(f"## {theme}")
        parts.append(claim_block(row))
    return "\n\n".join(parts)


def first_lines(text: str, most: int = 400) -> str:
    return "\n".join(text.split("\n")[:most])
