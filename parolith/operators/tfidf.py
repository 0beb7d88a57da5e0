"""Character and word n-gram TF-IDF in long form (id, term, weight), and similarities on it.

A text becomes a vector by explode and aggregates alone, so everything stays in the JVM and is as wide as the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolith.functions.patterns import S, W
from parolith.session import cut, free

#: English words left out of the word n-grams; a short list of function words, a parameter of the configuration.
STOP_WORDS = tuple("a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to was we were what when which who will with you your".split())


@dataclass(frozen=True)
class Grams:
    """kind is "char_wb" (n-grams inside blank-padded words) or "word"."""

    kind: str = "char_wb"
    least: int = 3
    most: int = 6
    max_share: float = 1.0
    max_terms: int | None = None
    stop_words: tuple[str, ...] = ()


CLUSTERING = Grams("char_wb", 3, 6, 0.9, 5000)
THRESHOLD = Grams("char_wb", 3, 5, 1.0, 1000)
COORDS_CHARS = Grams("char_wb", 2, 4, 1.0, 800)
COORDS_WORDS = Grams("word", 1, 2, 1.0, 500, STOP_WORDS)
COORDS_FALLBACK = Grams("char_wb", 3, 5)
DIAGNOSTICS = Grams("char_wb", 3, 5, 1.0, 1000)


def grams_of(text: Column, g: Grams) -> Column:
    """All n-grams of a text, with repetitions. A padded word no longer than n gives itself once and ends the n for it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if g.kind == "word":
        words = F.filter(F.regexp_extract_all(low, F.lit(rf"[{W}]{{2,}}"), F.lit(0)), lambda w: ~w.isin(*g.stop_words) if g.stop_words else F.lit(True))

        def word_run(n: int):
            return lambda i: F.array_join(F.slice(words, i, n), " ")

        parts = [F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), word_run(n))).otherwise(F.array().cast("array<string>")) for n in range(g.least, g.most + 1)]
        return F.concat(*parts)
    words = F.filter(F.split(low, rf"[{S}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def char_run(w: Column, n: int):
        return lambda i: F.substring(w, i, F.lit(n))

    def cut_up(w: Column) -> Column:
        size = F.char_length(w)
        parts = [F.when(size > g.least, F.array().cast("array<string>")).otherwise(F.array(w))]
        for n in range(g.least, g.most + 1):
            several = F.transform(F.sequence(F.lit(1), size - n + 1), char_run(w, n))
            if n == g.least:
                parts.append(F.when(size > n, several).otherwise(F.array().cast("array<string>")))
            else:
                # the padded word itself, once, at the first n that reaches its length
                parts.append(F.when(size > n, several).when(size == n, F.array(w)).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, cut_up))


def tfidf(df: DataFrame, id_col: str, text_col: str, g: Grams) -> DataFrame:
    """(id, term, w): counts times ln((1+n)/(1+df))+1, unit length. Terms beyond the cap go by total count, ties by term.

    Texts are parted by id before they are cut up, so counts and norms of a text need no shuffle of n-grams; what travels are the
    texts and the partial counts of terms.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = texts.count()
    width = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    # a number of partitions is named, or a small table would be put into one before it is cut up
    counts = texts.repartition(width, "id").select("id", F.explode(grams_of(F.col("text"), g)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") <= g.max_share * n)
    if g.max_terms is not None:
        terms = F.broadcast(cut(terms.orderBy(F.desc("total"), "term").limit(g.max_terms)))  # the cap bounds it
    weighted = counts.join(terms, "term").select("id", "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # the terms of one text
    return weighted.select("id", "term", (F.col("w") / norm).alias("w"))


def mean_similarity(vectors: DataFrame) -> Column | float | None:
    """Mean cosine over all pairs, without making one: (|sum of unit vectors|^2 - rows) / (n (n - 1)); null below two rows."""
    m = vectors.select("id").distinct().count()
    if m < 2:
        return None
    square = vectors.groupBy("term").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return (square - m) / (m * (m - 1))


def adaptive_threshold(n: int, similarity: float | None, start: float = 0.35) -> float:
    """Few items: at most a quarter. Many: at least 0.45. Between: looser or tighter by the mean similarity."""
    if n < 50:
        return min(0.25, start)
    if n > 500:
        return max(0.45, start)
    if similarity is None:
        return start
    return start * (0.8 if similarity > 0.3 else 1.2 if similarity < 0.1 else 1.0)


def used_threshold(items: DataFrame, id_col: str, text_col: str, start: float = 0.35) -> float:
    """The adaptive threshold of a table; similarities are looked at only where the number of rows leaves it open."""
    n = items.count()
    return adaptive_threshold(n, mean_similarity(tfidf(items, id_col, text_col, THRESHOLD)) if 50 <= n <= 500 else None, start)


def _basis(sample: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (width x directions) that hold most of the sample's length, by subspace iteration; and a group for each term.

    Terms that come up in the same texts, as those of one word do, are of one group.
    """
    rows, at = np.unique(sample["id"].to_numpy(), return_inverse=True)
    x = np.zeros((len(rows), width), "f4")
    x[at, sample["t"].to_numpy()] = sample["w"].to_numpy()
    most = min(BASIS_DIRECTIONS, *x.shape)
    spread = np.random.default_rng(0).standard_normal((width, min(width, most + 16)), dtype="f4")
    for _ in range(2):
        spread = np.linalg.qr(x.T @ (x @ spread))[0]
    turn = np.linalg.eigh((y := (x @ spread).astype("f8")).T @ y)[1][:, ::-1]
    basis = np.linalg.qr(spread.astype("f8") @ turn[:, :most])[0]
    load = basis * np.linalg.norm(x @ basis.astype("f4"), axis=0)
    load /= np.linalg.norm(load, axis=1, keepdims=True) + 1e-9
    middle = load[np.random.default_rng(1).choice(width, min(BASIS_GROUPS, width), False)]
    for _ in range(6):
        group = (load @ middle.T).argmax(1)
        for k in np.unique(group):
            middle[k] = (m := load[group == k].sum(0)) / (np.linalg.norm(m) + 1e-9)
    return basis.astype("f4"), group


def _coordinates(starts: np.ndarray, t: np.ndarray, w: np.ndarray, basis: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of unit rows the coordinates in the basis, and of what these leave out the length in each group of terms and outside of all."""
    n, groups = len(starts) - 1, int(group.max()) + 1
    made = np.zeros((n, basis.shape[1] + groups + 1), "f2")
    member = (group[:, None] == np.arange(groups)).astype("f4")
    for k in range(0, n, 512):
        own, size = slice(starts[k], starts[min(k + 512, n)]), np.diff(starts[k : k + 513])
        at, tt, ww = np.repeat(np.arange(len(size)), size), t[own], w[own]
        known = tt < len(basis)
        x = np.zeros((len(size), len(basis)), "f4")
        x[at[known], tt[known]] = ww[known]
        part = x @ basis
        x -= part @ basis.T
        rest = np.bincount(at[~known], ww[~known] ** 2, len(size))
        made[k : k + 512] = np.concatenate([part, np.sqrt((x * x) @ member), np.sqrt(rest)[:, None]], 1)
    return made


def _block(ids: np.ndarray, starts: np.ndarray, t: np.ndarray, n: np.ndarray, scale: np.ndarray, coordinates: np.ndarray) -> dict[str, bytes]:
    """A block as it is stored: terms in two bytes where that is enough; n are counts to be scaled, or weights."""
    t = t.astype("u2" if len(scale) and len(scale) <= 1 << 16 else "i8")
    parts = {"ids": ids.astype("i8"), "starts": starts.astype("i4"), "t": t, "n": n.astype("i4" if len(scale) else "f8"), "scale": scale.astype("f8"), "coordinates": coordinates.astype("f2")}
    return {c: v.tobytes() for c, v in parts.items()}


_BLOCK = "ids binary, starts binary, t binary, n binary, scale binary, coordinates binary"


def unpacked(row: dict[str, pa.Scalar], side: str = "", weights: bool = True) -> dict[str, np.ndarray]:
    """The arrays of a block, with weights or with counts only; coordinates where they were read."""

    def array(c: str, *kinds: str, count: int = 0) -> np.ndarray:
        held = row[c + side].as_buffer()
        return np.frombuffer(held, next((k for k in kinds if np.dtype(k).itemsize * count == held.size), kinds[0]))

    starts, scale = array("starts", "i4").astype("i8"), array("scale", "f8")
    t, n = array("t", "u2", "i8", count=starts[-1]), array("n", "i4", "f8", count=starts[-1])
    w = n if not len(scale) else scaled(starts, t, n, scale) if weights else np.zeros(0)
    made = {"ids": array("ids", "i8"), "starts": starts, "t": t, "n": n, "w": w}
    if "coordinates" + side in row:
        made["coordinates"] = array("coordinates", "f2").reshape(len(starts) - 1, -1).astype("f4")
    return made


def scaled(starts: np.ndarray, t: np.ndarray, n: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of unit length of rows of counts."""
    w = n * scale[t]
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts[:-1])), np.diff(starts))


def _packed(group: pa.Table, basis: np.ndarray, groups: np.ndarray) -> pa.Table:
    """The rows of a block, by id: sparse vectors, and what bounds their products."""
    ids, t, w = (group[c].to_numpy() for c in ("id", "t", "w"))
    order = np.lexsort((t, ids))
    ids, t, w = ids[order], t[order], w[order]
    rows, starts = np.unique(ids, return_index=True)
    starts = np.append(starts, len(ids))
    made = _block(rows, starts, t, w, np.zeros(0), _coordinates(starts, t, w, basis, groups))
    return pa.table({"block": group["block"].combine_chunks()[:1]} | {c: pa.array([v], pa.binary()) for c, v in made.items()})


def _counted(grams: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, count) of the given terms in rows of n-grams."""
    rows = np.repeat(np.arange(len(grams)), pc.list_value_length(grams).to_numpy())
    at = pc.fill_null(pc.index_in(grams.flatten(), value_set=terms), -1).to_numpy().astype("i8")
    keys, n = np.unique(rows[at >= 0] * len(terms) + at[at >= 0], return_counts=True)
    return keys // len(terms), keys % len(terms), n


def packed_tfidf(df: DataFrame, id_col: str, text_col: str, g: Grams) -> DataFrame:
    """The vectors of tfidf() for a capped number of terms, in blocks of rows: counts of terms, and what all of them are scaled by.

    An n-gram travels as a byte or three and never in a shuffle; a tenth of the room of (id, term, w). similar_pairs() and merge_tree() take
    either form. Rows without any term are in no block.
    """
    spark, texts = df.sparkSession, cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    n = texts.count()
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    grams = texts.repartition(width, "id").select("id", grams_of(F.col("text"), g).alias("grams"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["grams"].flatten().dictionary_encode()
            rows, k = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["grams"]).to_numpy()), len(own.dictionary)
            at = own.indices.to_numpy()
            df = np.bincount(np.unique(rows * k + at) % k, minlength=k) if k else np.zeros(0, "i8")
            yield pa.RecordBatch.from_pydict({"term": own.dictionary, "df": df, "total": np.bincount(at, minlength=k)})

    terms = grams.select("grams").mapInArrow(seen, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    terms = terms.where(F.col("df") <= g.max_share * n).orderBy(F.desc("total"), "term").limit(g.max_terms)
    terms = terms.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("scale")).collect()  # the cap bounds it
    if not terms:
        return spark.createDataFrame([], f"block long, {_BLOCK}")
    known, scale = pa.array([r["term"] for r in terms]), np.array([r["scale"] for r in terms])
    sample = grams.join(F.broadcast(texts.select("id").orderBy(F.xxhash64("id"), "id").limit(BASIS_ROWS)), "id").select("grams").toArrow()["grams"].combine_chunks()
    rows, t, w = _counted(sample, known)
    w = w * scale[t]
    w = w / np.sqrt(np.bincount(rows, w * w))[rows]
    basis, groups = _basis(pd.DataFrame({"id": rows, "t": t, "w": w}), len(known)) if len(rows) else (np.eye(len(known), 1, dtype="f4"), np.zeros(len(known), "i8"))
    most = min(max(n // 48, BLOCK_ROWS[0]), BLOCK_ROWS[1])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            t, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            order = np.argsort(ids)
            at = np.repeat(np.argsort(order), size)
            inside = np.argsort(at, kind="stable")  # terms of a row stay in their order
            ids, starts, t, n = ids[order], np.append(0, np.cumsum(size[order])), t[inside], n[inside]
            own = _block(ids, starts, t, n, scale, _coordinates(starts, t, scaled(starts, t, n, scale), basis, groups))
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64())} | {c: pa.array([v], pa.binary()) for c, v in own.items()})
            number += 1

        for batch in batches:
            for k in range(0, batch.num_rows, most):
                some = batch.slice(k, most)
                rows, t, n = _counted(some["grams"], known)
                if not len(rows):
                    continue
                at, size = np.unique(rows, return_counts=True)
                if held and held + len(at) > most:
                    yield from made()
                    held, parts = 0, []
                held += len(at)
                parts.append((some["id"].to_numpy()[at], size, t.astype("i4"), n.astype("i4")))
        if held:
            yield from made()

    return cut(grams.mapInArrow(blocks, f"block long, {_BLOCK}"), compression="zstd", maxRecordsPerFile=1)


#: Coordinates are kept in half precision and multiplied in single: their product is off by less than this for unit vectors.
SLACK = 2e-3


def products(x: dict[str, np.ndarray], y: dict[str, np.ndarray], tx: np.ndarray, ty: np.ndarray, width: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x, in ascending order and few enough to be held dense, with rows j of y; tx and ty are their terms below width."""
    low, size = i[0], np.diff(y["starts"])
    upto, rows = np.cumsum(size[j]), np.arange(low, i[-1] + 1)
    own = slice(x["starts"][low], x["starts"][rows[-1] + 1])
    dense = np.zeros((len(rows), width))
    dense[np.repeat(rows - low, np.diff(x["starts"][low : rows[-1] + 2])), tx[own]] = x["w"][own]
    dense, made = dense.ravel(), np.empty(len(i))
    for part in np.split(np.arange(len(i)), np.searchsorted(upto, np.arange(1 << 17, upto[-1], 1 << 17))):
        if not len(part):
            continue
        n = size[j[part]]
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(y["starts"][j[part]] - begin, n)
        made[part] = np.add.reduceat(dense.take(ty[at] + np.repeat((i[part] - low) * width, n)) * y["w"][at], begin)
    return made


def _near(x: dict[str, np.ndarray], y: dict[str, np.ndarray], least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id, cosine) of the pairs of two blocks, or of one, from least on."""
    tx, ty, width = x["t"], y["t"].astype("i8"), int(max(x["t"].max(), y["t"].max())) + 1
    if width > BASIS_TERMS:
        terms, local = np.unique(np.concatenate([tx, ty]), return_inverse=True)
        tx, ty, width = local[: len(tx)], local[len(tx) :], len(terms)
    px, py = x["coordinates"], y["coordinates"].T
    step = max(1, min(512, (1 << 22) // width))
    for k in range(0, len(x["ids"]), step):
        found = np.flatnonzero((px[k : k + step] @ py).ravel() >= least - SLACK)
        i, j = np.divmod(found, len(y["ids"]))
        if same:
            i, j = i[later := i + k < j], j[later]
        if not len(i):
            continue
        cosine = products(x, y, tx, ty, width, i + k, j)
        kept = cosine >= least
        yield x["ids"][k + i[kept]], y["ids"][j[kept]], cosine[kept]


#: Rows of a block, at least and at most; blocks between are a 48th of the table.
BLOCK_ROWS = (4_096, 32_768)
#: The terms of greatest mass that the basis may have, its directions, groups of terms, and the rows it is fitted on. None changes a result: what the basis lacks widens the bound.
BASIS_TERMS, BASIS_DIRECTIONS, BASIS_GROUPS, BASIS_ROWS = 8_192, 128, 128, 2_000


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of unit vectors with cosine >= least > 0, exactly. vectors: (id, term, w), or packed_tfidf().

    Blocks of rows meet in pairs, without a shuffle of terms or of products. In orthonormal coordinates, of which a hundred hold much of
    n-gram vectors, a cosine is the product of the coordinates plus at most that of the lengths they leave out in each group of terms. Pairs
    whose bound reaches least are multiplied as they are, in double precision; nothing is dropped that could reach it.
    """
    return _pairs(vectors, least)[0]


def kept_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """The similar pairs as a table of their own; what they were made from is removed."""
    pairs, read = _pairs(vectors, least)
    made = cut(pairs)
    if read:
        free(*read)
    return made


def _pairs(vectors: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """The similar pairs, and the tables that they are read from."""
    if "coordinates" in vectors.columns:
        return _met(vectors, least), []
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "term", "w")
    mass = cut(vectors.groupBy("term").agg(F.sum(F.col("w") * F.col("w")).alias("mass")))
    top = [r["term"] for r in mass.orderBy(F.desc("mass"), "term").limit(BASIS_TERMS).collect()]
    if not top:
        return spark.createDataFrame([], "a long, b long, cosine double"), []
    heads = F.broadcast(spark.createDataFrame(list(enumerate(top)), "t long, term string"))  # a bounded number
    numbers = heads
    if len(top) == BASIS_TERMS:
        numbers = cut(heads.unionByName(mass.join(heads, "term", "left_anti").select((F.monotonically_increasing_id() + BASIS_TERMS).alias("t"), "term")))
    ids = cut(vectors.select("id").distinct())
    n = ids.count()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("id"), "id").limit(BASIS_ROWS))
    basis, groups = _basis(vectors.join(chosen, "id").join(heads, "term").select("id", "t", "w").toPandas(), len(top))
    blocks = -(-n // min(max(n // 48, BLOCK_ROWS[0]), BLOCK_ROWS[1]))
    placed = vectors.join(numbers, "term").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "t", "w")
    packed = placed.groupBy("block").applyInArrow(lambda g: _packed(g, basis, groups), f"block long, {_BLOCK}")
    packed = cut(packed, compression="zstd", maxRecordsPerFile=1)
    return _met(packed, least), [packed]


def _met(packed: DataFrame, least: float) -> DataFrame:
    """The similar pairs of rows in blocks."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, dict] = {}  # a few blocks of one batch, each of which comes up several times
            for k in range(batch.num_rows):
                row = {c: batch[c][k] for c in batch.schema.names}
                x, y = (row[f"block_{side}"].as_py() for side in "xy")
                for block, side in ((x, "x"), (y, "y")):
                    if block not in held:
                        held[block] = unpacked(row, f"_{side}")
                for a, b, c in _near(held[x], held[y], least, x == y):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": c})

    x, y = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "xy")
    return x.join(y, F.col("block_x") <= F.col("block_y")).mapInArrow(pairs, "a long, b long, cosine double")
