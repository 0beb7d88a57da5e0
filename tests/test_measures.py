"""Hash samples, diagnosis, models, fetching and coordinates on small inputs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parolith import session
from parolith.functions import text as X
from parolith.operators import diagnostics, embed, models, tfidf
from parolith.sources import files, pages
from parolith.streaming import live


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hash_head_takes_the_first_of_each_key(spark):
    data = [(k, (None, "a", "b")[k % 3] if k % 7 else "c") for k in range(600)]
    wanted = {None: 50, "a": 0, "b": 10_000, "c": 1}
    df = spark.createDataFrame(data, "id int, key string").withColumn("h", F.md5(F.col("id").cast("string")))
    got = diagnostics.hash_head(df, ["key"], spark.createDataFrame(list(wanted.items()), "key string, k long"), "h", "id")
    assert got.columns == df.columns
    want = []
    for key, k in wanted.items():
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, x in data if x == key)
        want += [i for _, i in mine[:k]]
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert diagnostics.hash_head(df.limit(0), ["key"], spark.createDataFrame([("a", 3)], "key string, k long"), "h", "id").count() == 0


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

            class _conf:
                get = staticmethod(lambda *_: None)

            getConf = staticmethod(lambda: Fake.sparkContext._conf)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(Fake)


def test_models_and_rules(spark, tmp_path):
    df = spark.createDataFrame([("Good walls",), ("some bare line",), (None,)], "t string")
    yes = X.filter_cascade(F.col("t"), models.classifier(lambda prompt: " proverb" if "bare" in prompt else "NOT_PROVERB")(F.col("t")))
    assert [r[0] for r in df.select(yes).collect()] == [False, True, False]

    def broken(prompt):
        raise RuntimeError

    fails = X.filter_cascade(F.col("t"), models.classifier(broken)(F.col("t")))
    assert [r[0] for r in df.select(fails).collect()] == [r[0] for r in df.select(X.filter_cascade(F.col("t"))).collect()]
    assert models.find_model(str(tmp_path)) is None
    path = models.write_narrative(spark, "a\n" * 500, str(tmp_path / "n.txt"), lambda p: str(p.count("a\n")))
    assert int(files.read_text(spark, path)) >= 399
    assert models.narrative("x").startswith("No narrative") and "RuntimeError" in models.narrative("x", broken)


def test_fetch(spark):
    sources = spark.createDataFrame([("http://a.org/1",), ("http://a.org/2",), ("http://b.org/x",), ("http://b.org/x",), (None,)], "url string")

    def get(url):
        if url.endswith("2"):
            raise OSError("gone")
        return f"<p>{url}</p>"

    assert rows(pages.fetch_pages(sources, pause=0.0, get=get), "url", "html", "error") == [("http://a.org/1", "<p>http://a.org/1</p>", None), ("http://a.org/2", None, "OSError: gone"), ("http://b.org/x", "<p>http://b.org/x</p>", None)]


def test_coordinates_are_those_of_svd_and_principal_components(spark):
    data = [(k, " ".join(f"{'abc'[k % 3]}word{(k * j) % 5}" for j in range(1, 6))) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(data, "id int, t string")
    long = embed.side_by_side(df, "id", "t").toPandas().pivot_table(index="id", columns="term", values="w", fill_value=0.0)
    x = np.vstack([long.reindex(range(40)).to_numpy(), np.zeros((1, long.shape[1]))])
    u, s, v = np.linalg.svd(x, full_matrices=False)
    reduced = x @ v[: min(100, max(10, min(x.shape) - 1))].T
    centred = reduced - reduced.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    got = np.array([(r["x"], r["y"]) for r in embed.coordinates(df, "id", "t").orderBy("id").collect()])
    for c in range(2):
        assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-6
    assert rows(embed.coordinates(df.limit(2), "id", "t"), "x", "y") == [(0.0, 0.0)] * 2


def test_upsert_keeps_two_versions_and_stops_where_one_is_missing(spark, tmp_path):
    schema = "k int, at int, n int, v string"
    for batch, data in enumerate([[(1, 1, 1, "a")], [(1, 2, 2, "b"), (2, 1, 3, "c")], [(2, 5, 4, "d")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        live.upsert_ratings(stream, str(tmp_path / "out"), str(tmp_path / "state"), "k", "at", "n").awaitTermination()
    assert rows(live.newest_version(spark, str(tmp_path / "out")), "k", "v") == [(1, "b"), (2, "d")]
    assert not (tmp_path / "out" / "v=0").exists() and (tmp_path / "out" / "v=1").exists()
    files.delete(spark, str(tmp_path / "out" / "v=2"))
    spark.createDataFrame([(9, 9, 9, "z")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="missing"):
        live.upsert_ratings(live.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "state"), "k", "at", "n").awaitTermination()


def test_diagnosis_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, cluster_id int, claim string")
    report, advice = diagnostics.diagnose(empty, "claim", "id", spark.createDataFrame([], "id long, term string, w double"), spark.createDataFrame([], "significant boolean"))
    assert rows(report, "status", "total_clusters") == [("insufficient_data", 0)] and advice.count() == 1
    assert tfidf.tfidf(empty, "id", "claim", tfidf.CLUSTERING).count() == 0 and math.isnan(diagnostics.spearman_p(0.1, 2))
