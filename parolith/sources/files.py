"""Readers and writers: CSV, JSON and YAML in; CSV, JSON, Parquet, report and rating files out."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.operators.clean import union_sayings
from parolith.schemas import CLUSTERS, COORDS, PEOPLE_METADATA, SAYINGS, SOURCES, conform, empty

_CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as one text, from any file system."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, on any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_csv(spark: SparkSession, path: str, schema: T.StructType = SAYINGS) -> DataFrame:
    """A CSV with a header, by column name; absent columns are filled, others dropped."""
    return conform(spark.read.options(**_CSV).csv(path), schema)


def read_many_csv(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(union, [(path, error)]): a file that can't be read is reported and left out."""
    frames, failed = [], []
    for p in paths:
        try:
            frames.append(spark.read.options(**_CSV).csv(p))
        except Exception as e:  # noqa: BLE001
            failed.append((p, f"{type(e).__name__}: {e}"[:300]))
    return (union_sayings(frames) if frames else empty(spark, SAYINGS)), failed


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.options(**_CSV).csv(path), PEOPLE_METADATA, None)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of records with type, people and url; without a type it is a wikiquote page."""
    import yaml

    records = yaml.safe_load(read_text(spark, path)) or []
    rows = [(r.get("type") or "wikiquote", r.get("people"), r.get("url")) for r in records if isinstance(r, dict)]
    return spark.createDataFrame(rows, SOURCES)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a JSON array. One indented by two, as write_json_array makes it, is cut up at the ends of its records and read by many tasks.

    Any other is read whole by one task.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begins = b""
    if system.getFileStatus(where).isFile():
        read = system.open(where)
        begins = bytes(max(read.read(), 0) for _ in range(6))
        read.close()
    if begins != b"[\n  {\n":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    # a line that closes a record has two blanks before its brace, one within a record has more, and a text has no raw line feeds
    piece = F.regexp_replace("value", r"\s+\z", "")
    last, first = piece.endswith("\n]"), piece.startswith("[")
    piece = F.when(last, piece.substr(F.lit(1), F.length(piece) - 1)).otherwise(F.concat(piece, F.lit("\n  }")))
    piece = F.when(first, piece).otherwise(F.concat(F.lit("["), piece))
    rows = F.from_json(F.concat(piece, F.lit("]")), T.ArrayType(schema))
    rows = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("not a JSON array: "), F.substring("value", 1, 200)))).otherwise(rows)
    return spark.read.text(path, lineSep="\n  },\n").select(F.inline(rows))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters from Parquet or from a JSON array; a typed empty frame where there is no file."""
    if not exists(spark, path):
        return empty(spark, CLUSTERS)
    return read_json_array(spark, path, CLUSTERS) if ".json" in path else spark.read.parquet(path)


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.options(**_CSV).csv(path), COORDS) if exists(spark, path) else empty(spark, COORDS)


def decode_list(cell: Column) -> Column:
    """A list written as text, in JSON or with single quotes, as an array; anything else is an empty one."""
    quoted = F.regexp_replace(F.regexp_replace(cell, r"(?<=[\[, ])'|'(?=[,\]])", '"'), r'""', '"')
    parsed = F.coalesce(F.from_json(cell, "array<string>"), F.from_json(quoted, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have none."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_per_source(df: DataFrame, path: str) -> None:
    """Parquet partitioned by type and people, so a reader of one source lists one folder."""
    df.repartition("type", "people").write.mode("overwrite").partitionBy("type", "people").parquet(path)


def write_clusters(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _indented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """JSON texts as they stand in an indented array; a text has no raw line feeds, so each one indents a line."""
    for b in batches:
        yield pd.DataFrame({"value": ["  " + json.dumps(json.loads(r), ensure_ascii=False, indent=2).replace("\n", "\n  ") for r in b["value"]]})


def write_json_array(df: DataFrame, path: str) -> None:
    """One indented JSON array in one file, in the order of the rows.

    The tasks write its parts; the driver copies their bytes one after the other and holds none of the rows.
    """
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    parts, where = hadoop.fs.Path(f"{path}-parts-{uuid.uuid4().hex}"), hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    try:
        df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(_indented, "value string").write.option("lineSep", ",\n").text(parts.toString())
        made = sorted((f.getPath().getName(), f.getLen()) for f in system.listStatus(parts) if f.getPath().getName().startswith("part-"))
        made = [(name, size) for name, size in made if size]
        out = system.create(where, True)
        out.write(bytearray(b"[\n" if made else b"["))
        for k, (name, size) in enumerate(made):
            part = hadoop.fs.Path(parts, name)
            read = system.open(part)
            kept = spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(read, size - (2 if k == len(made) - 1 else 0))
            hadoop.io.IOUtils.copyBytes(kept, out, 1 << 16, False)  # the last row is followed by nothing
            read.close()
            system.delete(part, False)
        out.write(bytearray(b"\n]" if made else b"]"))
        out.close()
    finally:
        system.delete(parts, True)


def write_report(text: str, enriched: DataFrame, path: str) -> tuple[str, str]:
    """The report, and the enriched clusters beside it."""
    write_text(enriched.sparkSession, text, path)
    beside = re.sub(r"\.txt$", "", path) + "_enriched.json"
    write_json_array(enriched, beside)
    return path, beside


def write_ratings(ratings: DataFrame, summary: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Summary and details of the ratings in one JSON file, for a bounded number of human ratings."""
    rows = ratings.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ratings; write them as Parquet")
    details = [json.loads(r) for r in rows]
    first = summary.toJSON().first()
    write_text(ratings.sparkSession, json.dumps({"summary": json.loads(first) if first else {}, "ratings": details}, ensure_ascii=False, indent=2), path)
