"""Problem 2: claims in clusters, and every cluster with its size and most typical members.

``gaussian_clusters``: a Gaussian mixture fitted by expectation-maximisation. A claim's features are its words, hashed into
``HASHED`` places and weighted by inverse document frequency, reduced by principal components to ``REDUCED`` and
standardised. Covariances are full and regularised. The number of components doubles, by splitting each along its longest axis,
while the Bayesian information criterion improves; then the numbers between half and double the best are searched by halving
steps. Nothing but the criterion ends the search (``most`` may). EM ends when a round gains less than ``TOLERANCE`` a row, or after
``ROUNDS``. Every step (frequencies, moments, E-step) is a sum over all rows and one job: tasks send sums whose size depends on the
model alone, never rows, and where there are many tasks their sums are added up in groups before the driver adds the last few.
A row's squares and products are one vector, so E-step and sums are two matrix products. Members of highest density are a
cluster's most typical ones.

``alike_clusters``: claims linked by pairs that share two fifths of their long words, directly or over others. A mixture can't
give these: its components hold claims of one subject area and follow no threshold on word overlap (README has figures),
so the links come from the exact prefix-tree join of problem 3 at this lower threshold, and the clusters are its components.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import cut, not_blank, quoted, with_id
from parolith.operators.graph import components
from parolith.llm.p03_near import link_sets
from parolith.llm.textforms import fold

HASHED, REDUCED = 512, 12
ROUNDS, TOLERANCE, RIDGE = 40, 1e-3, 0.05
#: The number of components is searched in steps down to this share of it.
STEP = 0.125
#: Sums added up at once, in a task or on the driver.
FAN_IN = 16
LONG_WORD = re.compile(r"[^\W\d_]{7,}")
_WORD = re.compile(r"[^\W\d_]{4,}")


def long_words(text: str) -> set[str]:
    """The distinct words of seven or more letters, case ignored."""
    return set(LONG_WORD.findall(fold(text)))


def alike_clusters(df: DataFrame, id_col: str, text_col: str, t: tuple[int, int] = (2, 5)) -> DataFrame:
    """(first_id, id) of every claim of a cluster of two or more but its first (the least id).

    Claims with equal sets of long words are alike; null claims and claims without a long word are in no cluster.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out: tuple[list, list, list] = ([], [], [])
            for ident, text in zip(p["id"].tolist(), p["text"]):
                ws = long_words(text)
                if ws:
                    raw = np.array(sorted(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ws), dtype="<u8").tobytes()
                    out[0].append(ident)
                    out[1].append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    out[2].append(raw)
            yield pd.DataFrame({"field": pd.Series(np.zeros(len(out[0])), dtype="int32"), "id": pd.Series(out[0], dtype="int64"), "seq": pd.Series(out[1], dtype="int64"), "words": pd.Series(out[2], dtype="object")})

    texts = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).where(not_blank("text"))
    sets = cut(texts.mapInPandas(run, "field int, id long, seq long, words binary"))
    links, members = link_sets(sets, t)
    members = cut(members)
    groups = components(cut(links))
    linked = groups.select(F.col("node").alias("rep"), F.col("component").alias("first_id"))
    all_members = members.join(linked, "rep", "left").select(F.coalesce("first_id", "rep").alias("first_id"), "id")
    alone = linked.join(members.select("rep").distinct(), "rep", "left_anti").select("first_id", F.col("rep").alias("id"))
    return all_members.union(alone).where("id != first_id")


@dataclass
class Mixture:
    """idf: HASHED; mean, axes, scale: the reduction; weights, centres, covariances: the components."""

    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    centres: np.ndarray | None = None
    covariances: np.ndarray | None = None

    def hashed(self, texts: list[str]) -> np.ndarray:
        return hashed_counts(texts) * self.idf

    def features(self, texts: list[str]) -> np.ndarray:
        x = self.hashed(texts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return (x - self.mean) @ self.axes / self.scale

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """n x k: log of weight times density."""
        return products(x) @ self.coefficients().T

    def coefficients(self) -> np.ndarray:
        """k x products: what the log of weight times density makes of 1, the features, and their squares and products."""
        d = self.centres.shape[1]
        i, j = np.triu_indices(d)
        out = []
        for w, c, s in zip(self.weights, self.centres, self.covariances):
            p = np.linalg.inv(s)
            constant = np.log(w) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + c @ p @ c)
            out.append(np.concatenate([[constant], p @ c, p[i, j] * np.where(i == j, -0.5, -1.0)]))
        return np.array(out)


def products(x: np.ndarray) -> np.ndarray:
    """1, the features, and their squares and products (i <= j), one row per row."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def hashed_counts(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), HASHED))
    for i, t in enumerate(texts):
        for w in set(_WORD.findall(fold(t))):
            h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            x[i, h % HASHED] += 1.0 if h >> 63 else -1.0
    return x


def _rows_of(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)


def _sums(df: DataFrame, column: str, work: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Adds up over all rows the arrays work(batch) gives, in one job: an array per task, then one per group of tasks, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for p in batches:
            for at in range(0, p.num_rows, 10_000):
                part = work(p.column(0).slice(at, 10_000))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([np.asarray(total, dtype="<f8").tobytes()], pa.binary())})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [int(p["k"].min()) // FAN_IN], "v": [sum(np.frombuffer(v, dtype="<f8") for v in p["v"]).tobytes()]})

    parts = df.select(column).mapInArrow(run, "k int, v binary")
    width = df._jdf.rdd().getNumPartitions()
    while width > FAN_IN:
        parts = parts.groupBy(F.expr(f"k div {FAN_IN}")).applyInPandas(add, "k int, v binary")
        width = -(-width // FAN_IN)
    got = [np.frombuffer(r["v"], dtype="<f8") for r in parts.collect()]  # FAN_IN sums at most
    return np.sum(got, axis=0) if got else np.zeros(0)


def fit_mixture(texts: DataFrame, most: int | None = None) -> tuple[Mixture, DataFrame, list[tuple[int, float]]]:
    """(model, (id, x) features, [(components, criterion)]) for (id, text) rows without nulls."""
    counts = _sums(texts, "text", lambda s: np.concatenate([[len(s)], (hashed_counts(s.to_pylist()) != 0).sum(axis=0)]))
    n = int(counts[0]) if len(counts) else 0
    if not n:
        return Mixture(np.ones(HASHED), np.zeros(HASHED), np.eye(HASHED, REDUCED), np.ones(REDUCED), np.ones(1), np.zeros((1, REDUCED)), np.eye(REDUCED)[None]), texts.selectExpr("id", "cast(array() as array<double>) as x"), []
    model = Mixture(np.log((1 + n) / (1 + counts[1:])) + 1, np.zeros(HASHED), np.eye(HASHED), np.ones(HASHED))
    idf, upper = model.idf, np.triu_indices(HASHED)

    def moments(s: pa.Array) -> np.ndarray:
        x = hashed_counts(s.to_pylist()) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.concatenate([x.sum(axis=0), (x.T @ x)[upper]])

    got = _sums(texts, "text", moments)
    mean = got[:HASHED] / n
    second = np.zeros((HASHED, HASHED))
    second[upper] = got[HASHED:] / n
    values, vectors = np.linalg.eigh(second + np.triu(second, 1).T - np.outer(mean, mean))
    top = np.argsort(-values)[:REDUCED]
    model.mean, model.axes, model.scale = mean, vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top]), np.sqrt(np.maximum(values[top], 1e-9))
    base = model

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield pd.DataFrame({"id": p["id"], "x": list(base.features(list(p["text"])))})

    features = cut(texts.mapInPandas(project, "id long, x array<double>"))
    d = REDUCED
    model.weights, model.centres, model.covariances = np.ones(1), np.zeros((1, d)), np.eye(d)[None]
    history: list[tuple[int, float]] = []
    fitted: dict[int, tuple[float, Mixture]] = {}

    def criterion(start: Mixture) -> float:
        """Fits from this start; the criterion of the result, which is kept under its size."""
        now, log, before = start, -np.inf, -np.inf
        for turn in range(ROUNDS):
            log, after = _em_round(features, now)
            if turn and log - before < TOLERANCE * n:
                break
            now, before = after, log
        size = len(now.weights)
        got = float(-2 * log + np.log(n) * (size * (1 + d + d * (d + 1) / 2) - 1))
        fitted[size] = (got, now)
        history.append((size, got))
        return got

    best, low, high = 1, 1, None
    criterion(model)
    while 2 * best <= min(n, most or n):
        if criterion(_split(fitted[best][1], best)) >= fitted[best][0]:
            high = 2 * best
            break
        low, best = best, 2 * best
    step = best // 2
    while high is not None and (step := step // 2 if step else 0) >= max(1, STEP * best / 2):
        for size, start in ((best + step, best), (best - step, low)):
            if low < size < high and size not in fitted and criterion(_split(fitted[start][1], size - start)) < fitted[best][0]:
                low, best = (best, size) if size > best else (low, size)
                break
    return fitted[best][1], features, history


def _em_round(features: DataFrame, model: Mixture) -> tuple[float, Mixture]:
    """One round over all rows: the log likelihood before it, and the model after."""
    k, d = model.centres.shape
    coefficients = model.coefficients()

    def expect(s: pa.Array) -> np.ndarray:
        y = products(_rows_of(s))
        joint = y @ coefficients.T
        most = joint.max(axis=1, keepdims=True)
        share = np.exp(joint - most)
        whole = share.sum(axis=1, keepdims=True)
        return np.concatenate([[(most + np.log(whole)).sum()], ((share / whole).T @ y).ravel()])

    got = _sums(features, "x", expect)
    sums = got[1:].reshape(k, -1)
    mass = np.maximum(sums[:, 0], 1e-9)
    centres = sums[:, 1 : 1 + d] / mass[:, None]
    i, j = np.triu_indices(d)
    second = np.zeros((k, d, d))
    second[:, i, j] = second[:, j, i] = sums[:, 1 + d :] / mass[:, None]
    spread = second - centres[:, :, None] * centres[:, None, :]
    # the ridge counts as prior rows, so an almost empty component stays round
    spread = (spread * mass[:, None, None] + 10 * np.eye(d)) / (mass[:, None, None] + 10) + RIDGE * np.eye(d)
    return float(got[0]), Mixture(model.idf, model.mean, model.axes, model.scale, mass / mass.sum(), centres, spread)


def _split(model: Mixture, more: int) -> Mixture:
    """So many of the components in two, those of the most weight and spread, apart along the axis of their greatest spread in the features as they were before standardising."""
    axes = [np.linalg.eigh(s * model.scale[:, None] * model.scale) for s in model.covariances]
    chosen = set(np.argsort([-w * max(values[-1], 0) for w, (values, _) in zip(model.weights, axes)], kind="stable")[:more].tolist())
    weights, centres, covariances = [], [], []
    for place, (w, c, s, (values, vectors)) in enumerate(zip(model.weights, model.centres, model.covariances, axes)):
        step = vectors[:, -1] * np.sqrt(max(values[-1], 0)) * 0.7 / model.scale
        for sign, part in ((1, 2), (-1, 2)) if place in chosen else ((0, 1),):
            weights.append(w / part)
            centres.append(c + sign * step)
            covariances.append(s)
    return Mixture(model.idf, model.mean, model.axes, model.scale, np.array(weights), np.array(centres), np.array(covariances))


def gaussian_clusters(df: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """(id, cluster, log_density, probability) of every claim that isn't null or blank; clusters are numbered by falling weight.

    most may bound the number of components. An empty table gives an empty one; equal claims get equal rows; other columns take no part.
    """
    texts = cut(with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).where(not_blank("text")))
    model, features, _ = fit_mixture(texts, most)
    order = np.argsort(-model.weights, kind="stable")
    place = np.argsort(order, kind="stable")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            joint = model.log_joint(np.stack(list(p["x"])))
            top = joint.argmax(axis=1)
            best = joint[np.arange(len(p)), top]
            log = best + np.log(np.exp(joint - best[:, None]).sum(axis=1))
            yield pd.DataFrame({"id": p["id"], "cluster": pd.Series(place[top], dtype="int32", index=p.index), "log_density": best - np.log(model.weights[top]), "probability": np.exp(best - log)})

    return features.mapInPandas(assign, T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("log_density", T.DoubleType()), T.StructField("probability", T.DoubleType())]))


def describe_clusters(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster, size, typical_ids): the number of members of each cluster, and those of highest density (ties: least id)."""
    # the best of each cluster are kept per partition first, so a cluster with most of the rows sends as few as any other
    ranked = clusters.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    some = ranked.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(F.desc("log_density"), "id"))).where(F.col("r") <= typical)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("log_density"), "id"))).where(F.col("r") <= typical)
    tops = best.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("t")).select("cluster", F.col("t.id").alias("typical_ids"))
    return sizes.join(tops, "cluster")
