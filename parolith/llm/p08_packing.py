"""Problem 8: documents in containers of fixed capacity, with little room unused.

Method: optimal length buckets. Dynamic programming over the global histogram of lengths (with a convex hull, so in time
proportional to buckets x lengths) chooses the bucket boundaries that minimise padding. A batch of a bucket takes as many items
as its boundary allows in the token budget; the room it leaves goes to the longest bucket that still fits, and so on, so one
layout of buckets serves as many containers as the counts allow. The layouts are made from the bucket counts alone: their
number depends on the capacity and never on the number of documents.

Documents then take their place by their rank in their bucket: ranks are counted within (bucket, salt), the salts' offsets
come from a table of bounded size. No bucket, however large, meets in one task. An item longer than the capacity is cut
into full containers and a rest that is packed like any other item; no other item is cut.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolith.llm.common import bounded_rows, cut, quoted
from parolith.llm.tokens import token_counts

BUCKETS = 256
SALTS = 64


def best_boundaries(lengths: list[int], counts: list[int], most: int) -> list[int]:
    """Upper bounds of at most that many buckets over rising lengths, least padding in all."""
    n = len(lengths)
    if n <= most:
        return list(lengths)
    number, total = [0], [0]
    for length, c in zip(lengths, counts):
        number.append(number[-1] + c)
        total.append(total[-1] + c * length)
    inf = float("inf")
    cost = [0.0] + [inf] * n
    choice: list[list[int]] = []
    for _ in range(most):
        new, where = [inf] * (n + 1), [0] * (n + 1)
        hull: deque[tuple[float, float, int]] = deque()  # lines value = icept - slope * x, slope rises
        for j in range(1, n + 1):
            if cost[j - 1] < inf:
                line = (float(number[j - 1]), cost[j - 1] + total[j - 1], j - 1)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-2][0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][1] - hull[1][0] * x <= hull[0][1] - hull[0][0] * x:
                hull.popleft()
            new[j] = hull[0][1] - hull[0][0] * x + x * number[j] - total[j]
            where[j] = hull[0][2]
        choice.append(where)
        cost = new
    bounds, j = [], n
    for where in reversed(choice):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = where[j]
    return sorted(bounds)


def layouts(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(bucket, items per container)]): layouts that use up the counts, the longest bucket first."""
    left, out = list(counts), []
    while True:
        top = max((k for k in range(len(bounds)) if left[k]), default=-1)
        if top < 0:
            return out
        room, layout = capacity, []
        for k in range(top, -1, -1):
            take = min(room // bounds[k], left[k])
            if take:
                layout.append((k, take))
                room -= take * bounds[k]
        times = min(left[k] // take for k, take in layout)
        for k, take in layout:
            left[k] -= take * times
        out.append((times, layout))


def slots(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first rank, ranks, items per container, first container) of every bucket's part in every layout."""
    out, at, container = [], [0] * len(bounds), 0
    for times, layout in layouts(bounds, counts, capacity):
        for k, take in layout:
            out.append((k, at[k], times * take, take, container))
            at[k] += times * take
        container += times
    return out


def pack(df: DataFrame, id_col: str, text_col: str, specs: DataFrame, spec_col: str, capacity_col: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """(spec, capacity, container, bucket, id, piece, start_token, n_tokens): every token of every document, once for each spec.

    Null, empty and token-free texts need no room and give no row. Specs without a capacity of at least one token are none.
    A piece after the first is there only if the document is longer than the capacity. Containers count from 0.
    """
    spark = df.sparkSession
    wanted = [(r[0], int(r[1])) for r in bounded_rows(specs.select(quoted(spec_col).cast("int"), quoted(capacity_col)), 1000, "the table of capacities") if r[0] is not None and r[1] and r[1] > 0]
    sizes = cut(token_counts(df, id_col, text_col, path=path).where("n_tokens > 0"))
    pieces = sizes.withColumn("s", F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted]) if wanted else F.expr("array(struct(0 as spec, 0L as capacity))")))
    pieces = pieces.select("id", "n_tokens", "s.spec", "s.capacity").where("capacity > 0")
    pieces = pieces.withColumn("piece", F.explode(F.expr("sequence(0, cast((n_tokens - 1) div capacity as int))")))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("n", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start_token")))
    # at most as many rows as the capacities together
    told = pieces.groupBy("spec", "n").agg(F.count("*").alias("c")).toPandas() if wanted else None
    bound_rows, slot_rows = [], []
    for s, capacity in wanted:
        mine = told[told["spec"] == s].sort_values("n")
        lengths, counts = mine["n"].astype(int).tolist(), mine["c"].astype(int).tolist()
        bounds = best_boundaries(lengths, counts, buckets)
        place, per = 0, [0] * len(bounds)
        for length, c in zip(lengths, counts):
            while bounds[place] < length:
                place += 1
            per[place] += c
            bound_rows.append((s, length, place))
        slot_rows += [(s, *x) for x in slots(bounds, per, capacity)]
    of_length = spark.createDataFrame(bound_rows, "spec int, n long, bucket int")
    part = spark.createDataFrame(slot_rows, "spec int, bucket int, first_rank long, ranks long, per long, first_container long")
    rows = pieces.join(F.broadcast(of_length), ["spec", "n"]).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("spec", "bucket", "salt").orderBy("id", "piece")) - 1)
    amounts = rows.groupBy("spec", "bucket", "salt").agg(F.count("*").alias("c"))
    before = amounts.select("spec", "bucket", "salt", (F.sum("c").over(Window.partitionBy("spec", "bucket").orderBy("salt")) - F.col("c")).alias("before"))
    ranked = rows.join(before, ["spec", "bucket", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(part), (ranked["spec"] == part["spec"]) & (ranked["bucket"] == part["bucket"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    container = F.col("first_container") + F.expr("(rank - first_rank) div per")
    return placed.select(ranked["spec"], "capacity", container.alias("container"), ranked["bucket"], "id", "piece", "start_token", F.col("n").alias("n_tokens"))


def fill_report(packed: DataFrame) -> DataFrame:
    """(spec, capacity, containers, items, tokens, filled): how much of the containers' room is used."""
    each = packed.groupBy("spec", "capacity", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return each.groupBy("spec", "capacity").agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
