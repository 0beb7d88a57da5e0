"""Two coordinates per claim: TF-IDF of characters and words side by side, truncated SVD, principal components. Deterministic; a plug-in may replace the last step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolith.operators.tfidf import COORDS_CHARS, COORDS_FALLBACK, COORDS_WORDS, Grams, tfidf
from parolith.session import cut

#: Dimensions kept by the SVD, and terms at most for the fallback's covariance.
REDUCED, FALLBACK_TERMS = 100, 1300


def side_by_side(df: DataFrame, id_col: str, text_col: str, kinds: tuple[Grams, ...] = (COORDS_CHARS, COORDS_WORDS)) -> DataFrame:
    """(id, term, w): the terms of several kinds of n-gram, told apart by the kind's place."""
    made = None
    for k, g in enumerate(kinds):
        part = tfidf(df, id_col, text_col, g).select("id", F.concat(F.lit(f"{k}:"), "term").alias("term"), "w")
        made = part if made is None else made.union(part)
    return made


def projection(vectors: DataFrame, rows: int, reduced: int = REDUCED, wide: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, weights, offset): the linear map of a truncated SVD and principal components after it.

    Both come from the terms' Gram matrix, a sum over all rows whose size depends on the caps on terms alone.
    """
    sums = {r["term"]: r["s"] for r in vectors.groupBy("term").agg(F.sum("w").alias("s")).collect()}  # the caps on terms bound it
    terms = sorted(sums)
    places = vectors.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, place int")
    packed = vectors.join(F.broadcast(places), "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("x"))
    width = len(terms)
    sparse = F.udf(lambda x: Vectors.sparse(width, [e[0] for e in x], [e[1] for e in x]), VectorUDT(), useArrow=False)  # no built-in makes a sparse vector
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(packed.select(sparse("x").alias("x")), "x")).computeGramianMatrix().toArray()
    values, axes = np.linalg.eigh(gram)
    keep = np.argsort(-values, kind="stable")[: min(reduced, max(10, min(rows, width) - 1), width)]
    axes = axes[:, keep]
    mean = np.array([sums[t] for t in terms]) @ axes / rows
    spread = axes.T @ gram @ axes / rows - np.outer(mean, mean)
    values, turn = np.linalg.eigh(spread)
    turn = turn[:, np.argsort(-values, kind="stable")[:wide]]
    weights = axes @ turn
    sign = np.sign(weights[np.abs(weights).argmax(axis=0), range(weights.shape[1])])
    return terms, weights * sign, mean @ turn * sign


def coordinates(df: DataFrame, id_col: str, text_col: str, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, x, y): finite for every row; a table of fewer than three rows, or without a term, stands at the origin.

    ``project`` may be a callable from (id, term, w) to (id, x, y), such as a neighbour embedding. If the features can't be made, character
    n-grams alone are reduced.
    """
    ids = df.select(F.col(id_col).alias("id"))
    rows = ids.count()
    try:
        vectors = cut(side_by_side(df, id_col, text_col))
    except Exception:  # noqa: BLE001
        fallback = Grams(COORDS_FALLBACK.kind, COORDS_FALLBACK.least, COORDS_FALLBACK.most, max_terms=FALLBACK_TERMS)
        vectors = cut(side_by_side(df, id_col, text_col, (fallback,)))
    if project is not None:
        return project(vectors)
    if rows < 3 or vectors.isEmpty():
        return ids.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    terms, weights, offset = projection(vectors, rows)
    if weights.shape[1] < 2:
        weights, offset = np.hstack([weights, np.zeros((len(terms), 1))]), np.append(offset, 0.0)
    table = df.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(terms, weights)], "term string, wx double, wy double")
    placed = vectors.join(F.broadcast(table), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("wx")).alias("x"), F.sum(F.col("w") * F.col("wy")).alias("y"))
    full = ids.join(placed, "id", "left").na.fill(0.0, ["x", "y"])
    return full.select("id", (F.col("x") - float(offset[0])).alias("x"), (F.col("y") - float(offset[1])).alias("y"))
