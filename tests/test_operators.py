"""Operators against brute force and on built pages, streams and files."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parolith.operators import clean, clusters, diagnostics, embed, experiments, interpret, models, validation
from parolith.operators.graph import components
from parolith.operators.linkage import average_linkage, cluster_vectors, cophenetic_correlation
from parolith.operators.tfidf import Grams, mean_similarity, similar_pairs, tfidf
from parolith.schemas import CLUSTERS, SAYINGS, conform, empty
from parolith.sources import files, pages
from parolith.streaming import live


def naive_linkage(x, below):
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m))
        if not best[0] < below:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def unit(rng, n, d):
    x = np.abs(rng.normal(size=(n, d))) * (rng.random((n, d)) < 0.5) + 1e-3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_average_linkage_equals_naive():
    rng = np.random.default_rng(1)
    for _ in range(25):
        x = unit(rng, int(rng.integers(1, 14)), 6)
        below = float(rng.uniform(0.05, 0.7))
        got = {}
        for i, k in enumerate(average_linkage(x, below)):
            got.setdefault(k, []).append(i)
        assert {frozenset(g) for g in got.values()} == naive_linkage(x, below)


def test_cophenetic():
    x = unit(np.random.default_rng(9), 30, 6)
    d = 1 - x @ x.T
    groups, high = [[i] for i in range(30)], np.zeros((30, 30))
    while len(groups) > 1:
        h, k, m = min((np.mean(d[np.ix_(a, b)]), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m)
        high[np.ix_(groups[k], groups[m])] = high[np.ix_(groups[m], groups[k])] = h
        groups[k] += groups.pop(m)
    upper = np.triu_indices(30, 1)
    assert abs(cophenetic_correlation(x) - np.corrcoef(d[upper], high[upper])[0, 1]) < 1e-9


def vectors(spark, x):
    return spark.createDataFrame([(i, f"t{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v > 0], "id long, term string, w double")


def test_pairs_and_clusters_equal_brute_force(spark):
    x = unit(np.random.default_rng(3), 40, 9)
    x[x < 0.05] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = vectors(spark, x)
    sims = x @ x.T
    for least in (0.5, 0.8):
        want = {(i, j) for i in range(40) for j in range(i + 1, 40) if sims[i, j] >= least}
        assert {(r["a"], r["b"]) for r in similar_pairs(v, least).collect()} == want
    got = {}
    for r in cluster_vectors(v, spark.range(42), 0.3).collect():
        got.setdefault(r["cluster_id"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == naive_linkage(x, 0.3) | {frozenset({40}), frozenset({41})}
    assert sorted(got) == list(range(len(got))) and [min(got[k]) for k in sorted(got)] == sorted(min(g) for g in got.values())
    assert all(0.3 < r["adjusted_rand"] <= 1 for r in experiments.bootstrap_agreement(v, spark.range(40), 0.3, draws=2, ratio=0.9).collect())
    iu = np.triu_indices(40, 1)
    assert abs(mean_similarity(v) - sims[iu].mean()) < 1e-9


def test_pairs_of_many_blocks_without_a_shuffle_of_products(spark, monkeypatch):
    from parolith.operators import tfidf as module

    x = unit(np.random.default_rng(4), 60, 12)
    x[x < 0.1] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v, sims = vectors(spark, x), x @ x.T
    want = {(i, j): sims[i, j] for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.6}
    monkeypatch.setattr(module, "BLOCK_ROWS", (15, 15), raising=False)
    monkeypatch.setattr(module, "BASIS_TERMS", 8, raising=False)  # fewer than there are
    monkeypatch.setattr(module, "BASIS_DIRECTIONS", 3, raising=False)
    monkeypatch.setattr(module, "BASIS_ROWS", 20, raising=False)
    made = similar_pairs(v, 0.6)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): r["cosine"] for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similar_pairs(v.where("false"), 0.6).columns == ["a", "b", "cosine"] and similar_pairs(v.where("false"), 0.6).count() == 0


def test_packed_vectors_are_those_of_tfidf_in_little_room(spark, monkeypatch):
    from pathlib import Path

    from parolith.operators import tfidf as module
    from parolith.plans import catalog, measures  # noqa: F401  (adds its queries)

    rng = random.Random(13)
    words = ["".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(400)] + ["", "tick " * 300, None]
    df, g = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), Grams("char_wb", 3, 6, 0.9, 500)  # fewer terms than there are
    monkeypatch.setattr(module, "BLOCK_ROWS", (50, 50))
    monkeypatch.setattr(module, "BASIS_DIRECTIONS", 5)
    monkeypatch.setattr(module, "BASIS_GROUPS", 7, raising=False)
    long = tfidf(df, "id", "text", g)
    x = np.zeros((len(texts), 500))
    at: dict = {}
    for r in long.collect():
        x[r["id"], at.setdefault(r["term"], len(at))] = r["w"]
    blocks = module.packed_tfidf(df, "id", "text", g)
    held = [module.unpacked({c: pa.scalar(v) for c, v in r.asDict().items() if c != "block"}) for r in blocks.collect()]
    assert len({r["block"] for r in blocks.collect()}) == len(held) > 8
    assert sorted(i for b in held for i in b["ids"].tolist()) == np.flatnonzero(x.any(1)).tolist()
    for b in held:
        assert (np.diff(b["ids"]) > 0).all() and len(b["ids"]) <= 50
        for k, i in enumerate(b["ids"]):
            own = slice(b["starts"][k], b["starts"][k + 1])
            assert np.allclose(np.sort(b["w"][own]), np.sort(x[i][x[i] > 0]), atol=1e-12)
    sims = x @ x.T
    want = {(i, j): sims[i, j] for i, j in np.argwhere(np.triu(sims >= 0.4, 1)).tolist()}
    for v in (blocks, long):
        got = {(r["a"], r["b"]): r["cosine"] for r in similar_pairs(v, 0.4).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert similar_pairs(module.packed_tfidf(df.where("false"), "id", "text", g), 0.4).count() == 0

    size = lambda d: sum(p.stat().st_size for p in Path(d._cut_path.removeprefix("file:")).rglob("*.parquet"))
    tables, cut = [], module.cut
    monkeypatch.undo()
    for m in (module, catalog):
        monkeypatch.setattr(m, "cut", lambda df, **k: tables.append(cut(df, **k)) or tables[-1])
    assert catalog.QUERIES["pair_cosines"](spark, "/root/testdata/sf0.01").count() == 2702
    room = sum(map(size, tables))
    assert 0 < room < size(cut(catalog._item_vectors(spark, "/root/testdata/sf0.01")))


def test_queries_take_the_adaptive_threshold(spark, monkeypatch):
    from parolith.plans import catalog

    seen = []
    monkeypatch.setattr(catalog, "_item_vectors", lambda spark, sf_dir: spark.range(1))
    monkeypatch.setattr(catalog, "_items", lambda spark, sf_dir: spark.range(501).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("claim")))
    monkeypatch.setattr(catalog.linkage, "cluster_vectors", lambda v, ids, threshold: seen.append(threshold))
    monkeypatch.setattr(catalog.tfidf, "similar_pairs", lambda v, least: seen.append(1 - least))
    catalog.QUERIES["hac_clusters"](spark, "")
    catalog.QUERIES["pair_similarity"](spark, "")
    assert np.allclose(seen, 0.45)


def test_sweep_has_all_thresholds_and_silhouettes(spark):
    from parolith.plans import catalog

    x = unit(np.random.default_rng(12), 20, 6)
    v, d, seen = vectors(spark, x), 1 - x @ x.T, {}
    for r in experiments.threshold_sweep(v, spark.range(20), (0.2, 0.4)).collect():
        groups = naive_linkage(x, r["threshold"])
        scores = []
        for g in groups:
            for i in g if len(g) > 1 else ():
                a, b = d[i, list(g - {i})].mean(), min(d[i, list(h)].mean() for h in groups if h != g)
                scores.append((b - a) / max(a, b))
        seen[r["threshold"]] = abs(r["silhouette"] - sum(scores) / 20) < 1e-9 and r["n_clusters"] == len(groups) > 1
    assert seen == {0.2: True, 0.4: True}
    swept = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog, "_item_vectors", lambda spark, sf_dir: v)
        m.setattr(catalog.experiments, "threshold_sweep", lambda v, ids, thresholds: swept.extend(thresholds))
        catalog.QUERIES["tau_sweep"](spark, "")
    assert swept == [0.25, 0.3, 0.35, 0.4, 0.45]


def test_mixing_and_agreement_take_real_clusters(spark, monkeypatch, tmp_path):
    from parolith.plans import catalog

    claims = ["still waters run deep", "still waters run deeper", "haste makes waste", "hunger is the best sauce", "haste makes waste"]
    spark.createDataFrame([(k, f"P{k}", c) for k, c in enumerate(claims)], "ord long, people string, claim string").write.parquet(str(tmp_path / "items.parquet"))
    seen, mixing = [], experiments.mixing_baseline
    monkeypatch.setattr(catalog.experiments, "mixing_baseline", lambda m, value, **k: seen.append((m, k)) or mixing(m, value, **k))
    assert sorted(r["n_values"] for r in catalog.QUERIES["mixing_baseline"](spark, str(tmp_path)).collect()) == [1, 2, 2]
    members, given = seen[0]
    label = {r["ord"]: r["cluster_id"] for r in members.collect()}
    assert label[0] == label[1] != label[2] == label[4] != label[3] and "permutations" not in given
    at = []
    monkeypatch.setattr(catalog.linkage, "cluster_vectors", lambda v, ids, t, **k: at.append(t) or ids.select("id", (F.col("id") % (2 if t < 0.3 else 3)).alias("cluster_id")))
    assert catalog.QUERIES["threshold_rand"](spark, str(tmp_path)).first()[0] < 1 and at == [0.25, 0.45]


def test_large_components_are_merged_in_rounds(spark):
    x = unit(np.random.default_rng(11), 30, 8)
    v, want = vectors(spark, x), naive_linkage(x, 0.35)
    for bounds in ({"most_rows": 4}, {"most_rows": 1}):
        got = {}
        for r in cluster_vectors(v, spark.range(30), 0.35, **bounds).collect():
            got.setdefault(r["cluster_id"], set()).add(r["id"])
        assert {frozenset(g) for g in got.values()} == want and 1 < len(want) < 30


def test_rounds_in_blocks_give_the_clusters_at_every_threshold(spark, monkeypatch):
    from parolith.operators import linkage

    x = unit(np.random.default_rng(11), 30, 8)
    v, freed, free = vectors(spark, x), [], linkage.free
    monkeypatch.setattr(linkage, "SUM_ROWS", 7)
    monkeypatch.setattr(linkage, "free", lambda *tables: freed.extend(tables) or free(*tables))
    merges = linkage.merge_tree(v, 0.35, most_pairs=3)
    assert len(freed) > 3  # a round's tables don't stay
    for t in (0.2, 0.35):
        got = {}
        for r in linkage.cluster_vectors(v, spark.range(30), t, merges=merges).collect():
            got.setdefault(r["cluster_id"], set()).add(r["id"])
        assert {frozenset(g) for g in got.values()} == naive_linkage(x, t)


def test_packed_rows_are_merged_as_counts(spark, monkeypatch):
    from parolith.operators import linkage
    from parolith.operators.tfidf import packed_tfidf

    rng = random.Random(17)
    texts = [" ".join(rng.choice(["river", "boat", "oven", "stone", "bread", "night"]) for _ in range(rng.randrange(1, 4))) for _ in range(14)] + ["", "oven " * 3]
    df, g = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2), Grams("char_wb", 3, 6, 0.9, 60)
    x, at = np.zeros((16, 60)), {}
    for r in tfidf(df, "id", "text", g).collect():
        x[r["id"], at.setdefault(r["term"], len(at))] = r["w"]
    v = packed_tfidf(df, "id", "text", g)
    monkeypatch.setattr(linkage, "SUM_ROWS", 7)
    want = None
    for most in (12, 400_000):
        groups: dict = {}
        for r in cluster_vectors(v, df.select("id"), 0.35, most_pairs=most).collect():
            groups.setdefault(r["cluster_id"], set()).add(r["id"])
        got = {frozenset(k) for k in groups.values()}
        want = want or {frozenset(k) for k in map(frozenset, _groups(average_linkage(x, 0.35)))}
        assert got == want and 3 < len(want) < 14


def _groups(labels):
    made: dict = {}
    for i, k in enumerate(labels):
        made.setdefault(k, []).append(i)
    return made.values()


def test_two_thresholds_take_one_run_of_merges(spark, monkeypatch):
    from parolith.plans import catalog

    x = unit(np.random.default_rng(11), 16, 6)
    v, runs, tree = vectors(spark, x), [], catalog.linkage.merge_tree
    monkeypatch.setattr(catalog, "_item_vectors", lambda spark, sf_dir: v)
    monkeypatch.setattr(catalog.linkage, "merge_tree", lambda v, t, *a, **k: runs.append(t) or tree(v, t, *a, **k))
    assert -1 < catalog.QUERIES["threshold_rand"](spark, "").first()[0] <= 1 and runs == [0.45]


def test_bootstrap_makes_pairs_once(spark, monkeypatch):
    from parolith.operators import linkage

    x = unit(np.random.default_rng(5), 20, 6)
    v, made, pairs = vectors(spark, x), [], experiments.kept_pairs
    monkeypatch.setattr(experiments, "kept_pairs", lambda *a: made.append(a) or pairs(*a))
    monkeypatch.setattr(linkage, "kept_pairs", None)
    got = experiments.bootstrap_agreement(v, spark.range(20), 0.3, draws=1).first()["adjusted_rand"]
    kept = spark.range(20).where(F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(0), F.lit(0), F.col("id"))), 1, 8), 16, 10).cast("long") < int(0.8 * (1 << 32)))
    ids = [r["id"] for r in kept.collect()]
    whole, part = naive_linkage(x, 0.3), naive_linkage(x[ids], 0.3)
    frame = lambda groups, name: spark.createDataFrame([(name(i), k) for k, g in enumerate(groups) for i in g], "id long, cluster_id int")
    want = experiments.rand_index(frame(whole, int), frame(part, lambda i: ids[i])).first()[0]
    assert abs(got - want) < 1e-9 and len(made) == 1


def test_sweep_takes_one_run_of_merges(spark, monkeypatch):
    v, runs, tree = vectors(spark, unit(np.random.default_rng(12), 12, 6)), [], getattr(experiments, "merge_tree", None)
    monkeypatch.setattr(experiments, "merge_tree", lambda v, t: runs.append(t) or tree(v, t), raising=False)
    assert [r["threshold"] for r in experiments.threshold_sweep(v, spark.range(12), (0.2, 0.4)).collect()] == [0.2, 0.4] and runs == [0.4]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7), (None, 3)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def python_grams(text, g):
    out = []
    for w in text.lower().split():
        p = f" {w} "
        for n in range(g.least, g.most + 1):
            if len(p) <= n:
                out.append(p)
                break
            out += [p[i : i + n] for i in range(len(p) - n + 1)]
    return out


def test_tfidf_equals_python(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["river", "a", "be", "boat", "oven", "éa"]) for _ in range(rng.randrange(1, 6))) for _ in range(20)]
    g = Grams("char_wb", 3, 6, 0.9, 40)
    tf = [{t: ts.count(t) for t in ts} for ts in (python_grams(t, g) for t in texts)]
    df, total = {}, {}
    for c in tf:
        for t, k in c.items():
            df[t], total[t] = df.get(t, 0) + 1, total.get(t, 0) + k
    kept = sorted((t for t in df if df[t] <= 0.9 * 20), key=lambda t: (-total[t], t))[:40]
    want = {}
    for i, c in enumerate(tf):
        w = {t: c[t] * (np.log(21 / (1 + df[t])) + 1) for t in kept if t in c}
        norm = np.sqrt(sum(v * v for v in w.values()))
        want |= {(i, t): v / norm for t, v in w.items()}
    got = {(r["id"], r["term"]): r["w"] for r in tfidf(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", g).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_examples_rule(spark):
    rng = random.Random(8)
    names = ["English", "German", "Dutch", "Swedish", "Norwegian", "Spanish", "French", "Italian", "Russian", "Polish", "Czech", "Thai", "Korean", "Klingon", "Romulan", "Vulcan"]
    family = __import__("parolith.functions.labels", fromlist=["x"]).FAMILIES
    data, want = [], {}
    for c in range(30):
        chosen = sorted(rng.sample(names, rng.randrange(1, 15)))
        counts = {}
        for n in chosen:
            counts[family.get(n, "Other")] = counts.get(family.get(n, "Other"), 0) + 1
        kept = []
        for n in chosen:
            if counts[family.get(n, "Other")] <= 2 or len(kept) < 8:
                kept.append(n)
        want[c] = kept
        data += [(c, 1000 * c + k, n, f"{n} says") for k, n in enumerate(chosen)]
    got = {}
    for r in clusters.cluster_examples(spark.createDataFrame(data, "cluster_id int, row_id long, people string, saying string")).orderBy("place").collect():
        got.setdefault(r["cluster_id"], []).append(r["people"])
    assert got == want


def test_cleaning_keeps_first_and_fills(spark):
    data = [(2, "A", "Time is money.", None, None), (1, "A", " Time  is money.", "", " "), (3, "B", "Time is money.", "English equivalent: Haste makes waste.", "x"), (4, "B", "Nice.", None, None), (5, None, None, None, None)]
    df = spark.createDataFrame(data, "row_id long, people string, saying string, english_equivalent string, original string")
    got = sorted((r["row_id"], r["people"], r["basis"], r["original"]) for r in clean.clean_sayings(df).collect())
    assert got == [(1, "A", "Time is money.", "Time is money."), (3, "B", "Haste makes waste.", "x")]
    raw, ranked = clean.merge_and_clean([df.drop("original"), df.select("row_id", "people", "saying")])
    assert raw.count() == 10 and ranked.first()["quality_score"] >= 4
    assert clean.clean_sayings(df.limit(0)).count() == 0


def test_partitioning_changes_nothing(spark):
    df = spark.createDataFrame([(k, f"P{k % 3}", f"Time is money number {k % 7}.", None) for k in range(60)], "row_id long, people string, saying string, english_equivalent string")
    one = clusters.aggregate_clusters(clusters.prepare_claims(df.coalesce(1), dedup=False).withColumn("cluster_id", F.col("claim")).drop("basis"))
    many = clusters.aggregate_clusters(clusters.prepare_claims(df.repartition(8), dedup=False).withColumn("cluster_id", F.col("claim")).drop("basis"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_report(spark):
    made = spark.createDataFrame([(0, "Avoid haste.", 3.0, 3, 4, ["english", "Thai", "Zed"]), (1, "Plain claim.", 1.0, 1, 1, ["Zed"])], "cluster_id int, claim string, wisdom_score double, coverage int, support int, cultures array<string>")
    meta = spark.createDataFrame([("English", "North", "F1", "Cold"), ("Thai", "South", "F2", None)], "people string, region string, language_family string, climate_zone string")
    rows = {r["cluster_id"]: r for r in interpret.enrich_clusters(made, meta).collect()}
    assert rows[0]["t_regions"] == "North (1/3; 33%), South (1/3; 33%)" and rows[0]["t_climates"] == "Cold (1/3; 33%), None (1/3; 33%)" and rows[0]["t_trade"] == "? (2/3; 67%)"
    assert rows[1]["t_regions"] == "-" and rows[1]["theme"] == "Other"
    text = interpret.report_text(interpret.report_rows(interpret.enrich_clusters(made, meta)))
    assert text.index("Avoid haste.") < text.index("## Other") < text.index("Plain claim.")
    with pytest.raises(ValueError):
        interpret.enrich_clusters(made, meta.drop("region"))
    assert models.narrative("x").startswith("No narrative") and models.narrative("a\nb", lambda s: s[-3:].upper()) == "A\nB"


def test_quality_figures(spark):
    x = unit(np.random.default_rng(4), 24, 5)
    label = [k % 4 for k in range(23)] + [9]
    df = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(24)], "id long, v array<double>, l int")
    d = 1 - x @ x.T
    scores = []
    for i in range(24):
        own = [j for j in range(24) if label[j] == label[i] and j != i]
        if not own:
            scores.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(24) if label[j] == k]].mean() for k in set(label) if k != label[i])
        scores.append((b - a) / max(a, b))
    assert abs(diagnostics.silhouette(df, "v", "l")[0] - np.mean(scores)) < 1e-6
    assert diagnostics.silhouette(df.withColumn("l", F.col("id").cast("int")), "v", "l")[0] is None
    v = vectors(spark, x).join(df.select("id", F.col("l").alias("cluster_id")), "id")
    for r in diagnostics.compactness(v).collect():
        m = [i for i in range(24) if label[i] == r["cluster_id"]]
        assert abs(r["distance"] - d[np.ix_(m, m)][np.triu_indices(len(m), 1)].mean()) < 1e-9
    a = df.select("id", F.col("l").alias("cluster_id"))
    assert abs(experiments.rand_index(a, a.withColumn("cluster_id", F.col("cluster_id") + 5)).first()[0] - 1) < 1e-12


def test_coordinates_are_finite(spark):
    df = spark.createDataFrame([(k, f"claim number {k} of rivers") for k in range(9)] + [(9, ""), (10, None)], "id long, claim string")
    got = embed.coordinates(df, "id", "claim").collect()
    assert len(got) == 11 and all(np.isfinite([r["x"], r["y"]]).all() for r in got)
    assert embed.coordinates(df.limit(2), "id", "claim").count() == 2


def test_ratings(spark):
    df = spark.createDataFrame([(1, 1, "No", "Good", " ok ", "2024-01-01"), (2, 1, "Yes, clearly", "Excellent", None, "2024-01-02"), (3, 2, "?", None, "", "2024-01-02"), (4, 2, "No", "Poor", "", "2024-01-02")], "rating_id long, ord long, coherence string, quality string, comment string, rated_at string").withColumn("rated_at", F.to_timestamp("rated_at"))
    last = validation.latest_ratings(df, "ord", "rated_at", "rating_id")
    assert sorted((r["ord"], r["rating_id"]) for r in last.collect()) == [(1, 2), (2, 4)]
    s = validation.rating_summary(last).first()
    assert (s["avg_coherence"], s["avg_quality"], s["problem_clusters"], s["n_remarks"], s["verdict"]) == (3.0, 2.5, 1, 0, "mixed")


HTML = {
    "wikiquote": '<div id="mw-content-text"><div class="mw-parser-output"><ul><li>One two three<ul><li>Inner has three words</li></ul><li>One more saying here</li><li>One more saying here</li><li>Category:Foo and more</li><li>Category: Foo and more</li><li>ISBN 12 is here</li><li>Two words</li></ul><h2><span class="mw-headline" id="References">R</span></h2><ul><li>Under the stop heading</li></ul></div></div><ul><li>Outside of the content</li></ul>',
    "wiktionary_category": '<div id="mw-pages"><ul><li><a title="x">All that glitters</a></li><li><a>No title here</a></li></ul></div><ul><li><a title="y">Elsewhere</a></li></ul>',
    "wiktionary_appendix": '<div id="mw-content-text"><div class="mw-parser-output"><li>Keep this saying</li><li>Edit this page now</li><li>Keep this saying</li></div></div>',
    "gutenberg_html": "<p>Time flies.</p><p>Time flies fast.</p><p>No mark here at all</p><p>Copyright notice is here.</p><p>London:Press is here.</p><p>" + "w " * 21 + ".</p><script>var a = 1; b = 2.</script>",
    "internet_archive_html": "<ul><li>Three words only.</li><li>Four words are here.</li><li>No mark in these words</li></ul>",
}
WANT = {
    "wikiquote": {"One two three Inner has three words", "Inner has three words", "One more saying here", "Category: Foo and more"},
    "wiktionary_category": {"All that glitters"}, "wiktionary_appendix": {"Keep this saying"}, "gutenberg_html": {"Time flies fast."}, "internet_archive_html": {"Four words are here."},
}


def test_extractors(spark):
    fetched = spark.createDataFrame([(f"u/{k}", h) for k, h in HTML.items()], "url string, html string")
    sources = spark.createDataFrame([(k, "Folk", f"u/{k}") for k in HTML] + [("odd", "Folk", "u/odd"), ("wikiquote", "Folk", "u/none")], "type string, people string, url string")
    made, skipped = pages.build_from_pages(sources, fetched, "2024-05-01")
    got = {}
    for r in made.collect():
        got.setdefault(r["source_url"][2:], []).append(r["saying"])
        assert r["accessed"] == "2024-05-01" and r["original"] == r["saying"] and r["english_equivalent"] == ""
    assert {k: set(v) for k, v in got.items()} == WANT and len(got["wikiquote"]) == 4 and len(got["wiktionary_appendix"]) == 2
    assert sorted(r["reason"] for r in skipped.collect()) == ["not fetched", "unknown type"]
    many = fetched.limit(1).select(F.lit("u/many").alias("url"), F.lit("Folk").alias("people"), F.lit("<li>Four words are here.</li>" * 5100).alias("html"))
    assert pages.EXTRACTORS["internet_archive_html"][0](many).count() == 5000


def test_json_array_of_any_size(spark, tmp_path):
    path = str(tmp_path / "big.json")
    files.write_json_array(spark.range(1_000_001).select(F.col("id").cast("int").alias("cluster_id")), path)
    read = files.read_clusters(spark, path)
    assert read.agg(F.count("*"), F.sum("cluster_id")).first()[:] == (1_000_001, 500_000_500_000)
    odd = [(3, 'a "b"\n  },\n  {\n ] \u2028\r\\', ["x", "]"]), (None, None, None), (1, "ж  }", []), (2, None, ["\n]"])]
    made = conform(spark.createDataFrame(odd, "cluster_id int, claim string, cultures array<string>"), CLUSTERS).orderBy(F.desc("cluster_id"))
    for df in (made, made.where("false"), made.where("cluster_id = 1"), made.where("cluster_id is null").select("cluster_id")):
        files.write_json_array(df, path)
        want = df.collect()
        assert (tmp_path / "big.json").read_text(encoding="utf-8") == json.dumps([json.loads(r) for r in df.toJSON().collect()], ensure_ascii=False, indent=2)
        assert [r["cluster_id"] for r in files.read_clusters(spark, path).collect()] == [r["cluster_id"] for r in want]
    files.write_json_array(made, path)
    assert files.read_clusters(spark, path).collect() == made.collect()
    for text in ('[{"cluster_id": 1}, {"cluster_id": 2}]', '[\n  {\n    "cluster_id": 1\n  }, {"cluster_id": 2},\n  {\n  "cluster_id": 3\n  },\n  {}\n]\n'):
        (tmp_path / f"hand{len(text)}.json").write_text(text)
        assert [r["cluster_id"] for r in files.read_clusters(spark, str(tmp_path / f"hand{len(text)}.json")).collect()] == ([1, 2] if "3" not in text else [1, 2, 3, None])
    assert not [f.name for f in tmp_path.iterdir() if "parts" in f.name]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('people,saying,extra\nA,"Line one\nline ""two""",x\nB,,y\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == SAYINGS.names and df.count() == 2 and df.where("people = 'A'").first()["saying"] == 'Line one\nline "two"'
    union, failed = files.read_many_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")])
    assert union.count() == 2 and len(failed) == 1
    (tmp_path / "s.yaml").write_text("- {people: A, url: u1}\n- {type: gutenberg_html, people: B, url: u2}\n", encoding="utf-8")
    assert sorted(r["type"] for r in files.read_sources(spark, str(tmp_path / "s.yaml")).collect()) == ["gutenberg_html", "wikiquote"]
    made = conform(spark.createDataFrame([(1, "c", ["x", "y"])], "cluster_id int, claim string, cultures array<string>"), CLUSTERS)
    files.write_json_array(made, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())[0]["cultures"] == ["x", "y"]
    assert files.read_clusters(spark, str(tmp_path / "c.json")).first()["cultures"] == ["x", "y"] and files.read_clusters(spark, str(tmp_path / "no.json")).count() == 0
    cells = spark.createDataFrame([("['a', 'b']",), ('["c"]',), ("[]",), ("junk",), (None,)], "v string")
    assert [r[0] for r in cells.select(files.decode_list(F.col("v"))).collect()] == [["a", "b"], ["c"], [], [], []]
    files.write_csv(made, str(tmp_path / "out"))
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "out")).first()["cultures"] == '["x","y"]'
    assert empty(spark, CLUSTERS).count() == 0


def test_rating_stream(spark, tmp_path):
    schema = "rating_id long, ord long, coherence string, rated_at timestamp"
    for k, rows in enumerate([[(1, 1, "a", 1), (2, 2, "b", 1)], [(3, 1, "c", 2), (4, 2, "d", 0)]]):
        df = spark.createDataFrame(rows, "rating_id long, ord long, coherence string, t long").select("rating_id", "ord", "coherence", F.timestamp_seconds("t").alias("rated_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.upsert_ratings(stream, str(tmp_path / "out"), str(tmp_path / "state"), "ord", "rated_at", "rating_id").awaitTermination()
        last = spark.read.parquet(str(tmp_path / "out" / f"v={k}"))
    assert sorted((r["ord"], r["rating_id"]) for r in last.collect()) == [(1, 3), (2, 2)]
