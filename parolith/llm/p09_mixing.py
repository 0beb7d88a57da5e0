"""Problem 9: documents of several sources mixed to target shares.

Method: weighted fair queueing. Each source's documents are shuffled (by a hash of the id); a document's virtual finish time
is the number of its source's tokens up to and with it, divided by the source's target share. Sorted by that time, every
beginning of the mixture has the target shares; it ends at the total budget: the largest at which no source has to be repeated
more often than allowed. A source that must be repeated goes round again after its last document.

The running sums of a source are taken within (source, slice of the hash range); the slices' offsets come from a table with
a bounded number of rows per source, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolith.llm.common import bounded_rows, cut, quoted
from parolith.llm.tokens import token_counts

SLICES = 1024
SEED = 20


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, budget: int | None = None, most_targets: int = 100_000, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, shares) for targets with the columns mix_id, source, target_share and max_repeats.

    rows: (mix_id, source, id, turn, n_tokens, finish), ordered by mix and finish time; turn counts the repetitions from 0.
    shares: (mix_id, source, target_share, max_repeats, source_tokens, used_tokens, used_docs, turns, actual_share).
    A source without a document, without a token, or with a share that isn't positive gives nothing, and shares report 0
    for it; the others keep their proportions. Documents with a null source, or in no target, take no part. A budget below
    the largest possible one ends the mixture there. Repeated ids are documents of their own.
    """
    spark = df.sparkSession
    spec = targets.select(quoted("mix_id").cast("int").alias("mix_id"), quoted("source").cast("string").alias("source"), quoted("target_share").cast("double").alias("target_share"), quoted("max_repeats").cast("int").alias("max_repeats"))
    listed = bounded_rows(spec.where("mix_id is not null and source is not null"), most_targets, "the table of targets")
    wanted = spark.createDataFrame(listed, spec.schema)
    names = F.broadcast(wanted.select("source").distinct())  # most_targets at most
    sized = token_counts(df.select(id_col, text_col, source_col), id_col, text_col, (source_col,), path).withColumnRenamed(source_col, "source")
    docs = cut(sized.join(names, "source", "left_semi").where("n_tokens > 0").withColumn("h", F.xxhash64("id", F.lit(SEED))).withColumn("slice", F.pmod(F.shiftright("h", 54), F.lit(SLICES)).cast("int")))
    per_slice = docs.groupBy("source", "slice").agg(F.sum("n_tokens").alias("t"))
    offsets = per_slice.select("source", "slice", (F.sum("t").over(Window.partitionBy("source").orderBy("slice")) - F.col("t")).alias("before"))
    totals = {r["source"]: int(r["t"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row per source in the targets
    plan = []
    for m in sorted({r["mix_id"] for r in listed}):
        mine = [r for r in listed if r["mix_id"] == m]
        able = [r for r in mine if totals.get(r["source"]) and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
        room = min((r["max_repeats"] * totals[r["source"]] / r["target_share"] for r in able), default=0.0)
        share = sum(r["target_share"] for r in able)
        ends = min(room, budget / share) if budget is not None and share else room
        for r in able:
            turns = min(r["max_repeats"], int(-(-ends * r["target_share"] // totals[r["source"]])))
            plan.append((m, r["source"], r["target_share"], totals[r["source"]], max(turns, 1), ends))
    todo = F.broadcast(spark.createDataFrame(plan, "mix_id int, source string, target_share double, source_tokens long, turns int, ends double"))
    run = F.sum("n_tokens").over(Window.partitionBy("source", "slice").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    summed = docs.withColumn("run", run).join(offsets, ["source", "slice"]).withColumn("upto", F.col("run") + F.col("before"))
    copies = summed.join(todo, "source").withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)")))
    done = F.col("turn") * F.col("source_tokens") + F.col("upto")
    # the document that crosses the end stays if the greater part of it lies before
    inside = (done - F.col("n_tokens") / 2) <= F.col("ends") * F.col("target_share")
    rows = copies.where(inside).select("mix_id", "source", "id", "turn", "n_tokens", (done / F.col("target_share")).alias("finish"))
    used = rows.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_docs"), (F.max("turn") + 1).alias("turns"))
    full = wanted.join(used, ["mix_id", "source"], "left").join(spark.createDataFrame(list(totals.items()), "source string, source_tokens long"), "source", "left").na.fill(0, ["used_tokens", "used_docs", "turns", "source_tokens"])
    whole = F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    shares = full.select("mix_id", "source", "target_share", "max_repeats", "source_tokens", "used_tokens", "used_docs", "turns", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"))
    return rows.orderBy("mix_id", "finish", "source", "id", "turn"), shares
