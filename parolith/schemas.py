"""Explicit schemas of the engine's tables, and a way to bring a frame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


SAYINGS = _strings("people original saying english_equivalent source_title source_url accessed")
SOURCES = _strings("type people url")
PEOPLE_METADATA = _strings(
    "people region language_family climate_zone coastal is_island maritime_orientation trade_route_proximity migration_hub "
    "subsistence_bias staple_crop legal_origin urbanization_level individualism_proxy uncertainty_avoidance_proxy"
)
_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def _typed(**kinds: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k) for n, k in kinds.items()])


CLUSTERS = _typed(
    cluster_id="int", claim="string", wisdom_score="double", coverage="int", support="int", cultures="strings", language_families="strings", family_diversity="int",
    examples=T.MapType(T.StringType(), T.StringType()), avg_claim_length="double", processing_metadata=_typed(distance_threshold="double", original_threshold="double"),
)
COORDS = _typed(cluster_id="int", claim="string", coverage="int", support="int", wisdom_score="double", family_diversity="int", x="double", y="double")
RATINGS = _typed(cluster_id="int", coherence="string", quality="string", comment="string", rated_at="timestamp")
SENSITIVITY = _typed(threshold_tau="double", n_items_evaluated="int", n_clusters="int", silhouette_cosine="double", cophenetic_corr="double", bootstrap_ari_mean="double")


def conform(df: DataFrame, schema: T.StructType, missing: object = "") -> DataFrame:
    """The schema's columns in order, cast; one that is absent is filled (blank for text, null else)."""
    made = []
    for f in schema:
        if f.name in df.columns:
            made.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            made.append((F.lit(missing) if isinstance(f.dataType, T.StringType) else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*made)


def empty(spark, schema: T.StructType) -> DataFrame:
    """A typed relation without rows."""
    return spark.createDataFrame([], schema)
