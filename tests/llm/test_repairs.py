"""Cases in which rows, votes or stretches were once lost or counted twice."""

import os
import random
import time

import numpy as np

import pytest
from pyspark.sql import functions as F

from parolith.llm.p01_language import PENALTY, choose_languages, fit_grams, language_of_label, mixture, posterior, sample_labelled, stretches, tokens_of
from parolith.llm.p02_clusters import Mixture, _sums, fit_mixture
from parolith.llm.p03_near import bucket_keys, expand_pairs, hash_all, link_sets, narrower, packed, word_sets
from parolith.llm.p04_copies import cheap_invariants, find_copies
from parolith.llm.p05_main_body import judge_lines
from parolith.llm.p06_entries import EntryTrie, common_ends, map_entries, near_entries
from parolith.llm.p10_sentences import list_items, sentences
from parolith.llm.textforms import fold, one_form, words


DATA = "/root/testdata/sf0.01"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# folding and copies (4)


def test_fold_is_one_for_all_cases():
    for c in map(chr, range(0x30000)):
        if not 0xD800 <= ord(c) < 0xE000:
            cases = {c.upper(), c.lower(), c.title()} if len(c.upper()) == 1 or c == "ß" else {c.lower()}  # a ligature is no case of its letters
            assert {fold(x) for x in cases} == {fold(c)} == {fold(fold(c))}, c


def test_cheap_invariants_never_part_equal_keys(spark):
    """Counts are sums over characters, so it is enough that each character counts as what it folds to."""
    data = [(ord(c), c, " ".join(words(c))) for c in map(chr, range(1, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame(data, "k int, a string, b string")
    apart = df.where(cheap_invariants(F.col("a"), F.lit(None)) != cheap_invariants(F.col("b"), F.lit(None)))
    assert apart.limit(5).collect() == []


def test_copies_under_folding(spark):
    data = [(1, "Große Straße.", "x"), (2, "GROSSE STRASSE", "X"), (3, "GROẞE straße", "x!"), (4, "x", "grosse strasse"), (5, "fin Kelvin", None), (6, "FIN kelvin", ""), (9, "ﬁn kelvin", None), (7, "οδος", None), (8, "ΟΔΟΣ", None)]
    copies, groups = find_copies(spark.createDataFrame(data, "row_id long, a string, b string"), "row_id", "a", "b", skip_form_cases=False)
    assert rows(copies, "first_id", "id") == [(1, 2), (1, 3), (1, 4), (5, 6), (7, 8)]
    assert rows(groups, "first_id", "n_copies") == [(1, 4), (5, 2), (7, 2)]


# main bodies (5)


def test_a_page_has_one_vote_for_a_line(spark):
    pages = [(1, "http://a.org/x", "Kiri", "Kiri\n" + "The same remark.\n" * 5 + "A saying of theirs.")]
    pages += [(k, f"http://b{k}.org/y", "Kiri", "Kiri\nThe same remark.\nSaying number of its own " + "abcdefgh"[k] + ".") for k in range(2, 4)]
    got = judge_lines(spark.createDataFrame(pages, "page long, url string, people string, text string"), "page", "url", "people", "text")
    assert got.where("not main").count() == 0


# sentences (10)


def parts(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize("deep", [3, 40, 200])
def test_closing_marks_find_their_opener_at_any_depth(deep):
    text = f"He said (one. {'[' * deep} two. three) and went. Then he left."
    assert parts(text) == [f"He said (one. {'[' * deep} two. three) and went.", "Then he left."]


def test_list_levels():
    text = "We need:\n1. Bread. And more bread\n  a) brown\n  b) white\n2. Milk\n- one\n- two\n\nIt ended in May\n64. Nobody knew"
    assert parts(text) == ["We need:", "1. Bread.", "And more bread", "a) brown", "b) white", "2. Milk", "- one", "- two", "It ended in May", "64. Nobody knew"]
    assert list_items("A line\n1. alone here") == list_items("x\n- alone") == list_items("") == {}
    assert len(list_items("1. a\n2. b\n4. wrapped\n3. c")) == 3


def test_wrapped_text_takes_linear_time():
    def seconds(n):
        text = ("a wrapped line of words that goes on and on without a stop\n" * n)[:-1]
        began = time.perf_counter()
        assert len(sentences(text)) == 1
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.01)


# forms (7)


@pytest.mark.parametrize("text, form", [
    ("Chapter Ⅳ", "Chapter IV"), ("ϲat and mouse", "cat and mouse"), ("Ꮃater runs", "Water runs"), ("ꓢtone by ꓢtone", "Stone by Stone"), ("ⲟld gold", "old gold"), ("ɡold and lɑnd", "gold and land"), ("оне ϲам", "оне сам"),
])
def test_wider_look_alikes(text, form):
    assert one_form(text) == form
    assert one_form(form) == form


@pytest.mark.parametrize("text", ["ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᎪ", "ꓡꓲ-ꓢꓴ ꓥꓳ", "ⲛⲓⲙ ⲡⲉ ⲟⲛ", "λόγος ϲοφία", "[ɡɑːdən] ɪz", "〇一"])
def test_other_scripts_stay(text):
    assert one_form(text) == text


def test_forms_of_long_mixed_text_take_linear_time():
    began = time.perf_counter()
    one_form("оса " * 40_000 + "word")
    assert time.perf_counter() - began < 5


# entries (6)


def test_equally_near_entries():
    trie = EntryTrie(["Iris", "Irish", "Malay", "Mali"])
    assert trie.best("Irih") == ("Irish", 1) and dict(trie.ranked("Irih")) == {"Iris": 1, "Irish": 1}
    assert trie.best("Malai") == ("Malay", 1) and dict(trie.ranked("Malai")) == {"Malay": 1, "Mali": 1}
    assert [common_ends(a, b) for a, b in (("abc", "abc"), ("abc", "axc"), ("", "a"), ("aa", "aaa"), ("xyz", "abc"))] == [3, 2, 0, 2, 0]


def test_near_entries_and_aliases(spark):
    df = spark.createDataFrame([(1, "Malai"), (2, "the Old Folk nation"), (3, "Holland"), (4, None), (5, " "), (1, "Malai"), (7, "nothing at all")], "row_id long, v string")
    listed = spark.createDataFrame([("Malay",), ("Mali",), ("Old Folk",), ("Dutch",), (None,), ("",)], "e string")
    got = rows(near_entries(df, "row_id", "v", listed, "e", aliases={"Dutch": ["Holland"]}), "id", "entry", "distance")
    assert got == [(1, "Malay", 1), (1, "Malay", 1), (1, "Mali", 1), (1, "Mali", 1), (2, "Old Folk", 0), (3, "Dutch", 0), (7, "", -1)]
    assert rows(map_entries(df, "row_id", "v", listed, "e", nouns=()), "id", "entry") == [(1, "Malay"), (1, "Malay"), (2, ""), (3, ""), (7, "")]
    assert near_entries(df.limit(0), "row_id", "v", listed, "e").count() == 0


# languages (1)


def scores(*rows):
    return np.array(rows, dtype="f4"), np.zeros(len(rows), dtype="i8")


def test_stretches_between_two_languages_neither_of_which_is_best():
    a, b = (0.0, -5.0, -2.9), (-5.0, 0.0, -2.9)
    score, owner = scores(*([a] * 2 + [b] * 2) * 3)
    assert choose_languages(score, owner, 1)[0].sum() > 1
    score, owner = scores(*([a] * 6))
    assert choose_languages(score, owner, 1).tolist() == [[True, False, False]]


def test_language_sets_equal_those_of_a_full_search():
    """No bound may change an answer: growing the set by trying every language with EM gives the same one."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, k = int(rng.integers(4, 40)), 5
        score = -rng.gamma(1.0, 3.0, (n, k)).astype("f4")
        score[np.arange(n), rng.integers(0, 3, n)] = 0
        score -= score.max(axis=1, keepdims=True)
        owner = np.zeros(n, dtype="i8")
        chosen = {int(score.sum(axis=0).argmax())}
        now = float(score.sum(axis=0, dtype="f8").max())
        while True:
            best = None
            for j in set(range(k)) - chosen:
                allowed = np.zeros((1, k))
                allowed[0, [*chosen, j]] = 1
                log = float(mixture(score.astype("f8"), owner, 1, allowed)[1][0])
                if best is None or log > best[0]:
                    best = (log, j)
            if best is None or best[0] - now <= PENALTY:
                break
            now, chosen = best[0], chosen | {best[1]}
        got = set(np.flatnonzero(choose_languages(score, owner, 1)[0]).tolist())
        gate_only = len(got) == 1 and len(chosen) > 1
        if gate_only:  # settled by the bound on paths: no change may pay
            path = [now_ for now_ in stretches(score, np.ones(n, bool), np.arange(k))]
            assert len(path) == 1
        else:
            assert got == chosen


def test_sample_takes_its_share_of_labelled_rows(spark):
    df = spark.range(20_000).select(F.col("id"), F.concat(F.lit("text "), F.col("id")).alias("t"), F.expr("if(id % 100 = 0, 'en', null)").alias("l"))
    assert sample_labelled(df, "id", "t", "l", 150).count() == 150
    assert sample_labelled(df, "id", "t", "l", 5_000).count() == 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_confidence_is_the_share_of_right_answers(spark):
    got = sample_labelled(spark.read.parquet(f"{DATA}/sayings_raw.parquet"), "row_id", "saying", "saying_lang", 20_000).toPandas()
    got = got.assign(label=got["label"].map(language_of_label)).dropna()
    train, held = got.iloc[::2], got.iloc[1::2]
    grams = fit_grams(train["text"].tolist(), train["label"].tolist())
    whole = fit_grams(got["text"].tolist(), got["label"].tolist())
    for n in (1, 2, 4):
        right, sure = [], []
        for t in held["text"]:
            ws = tokens_of(t)
            if len(ws) > 5:
                p = posterior(grams.words(ws[:n]).sum(axis=0, dtype="f8"))
                right.append(p.argmax() == whole.words(ws).sum(axis=0).argmax())
                sure.append(p.max())
        assert abs(np.mean(right) - np.mean(sure)) < 0.06, (n, np.mean(right), np.mean(sure))


# near copies (3)


@pytest.mark.parametrize("t", [(3, 4), (2, 5), (4, 5)])
def test_narrower_buckets_lose_no_pair(t):
    """Whatever buckets are too large, two alike sets still meet, over as many rounds as one likes."""
    rng = random.Random(7)
    for _ in range(120):
        base = {rng.randrange(50) for _ in range(rng.choice((1, 2, 3, 5, 9, 20, 40)))}
        other = {w if rng.random() < 0.85 else rng.randrange(50) for w in base}
        if len(base & other) * t[1] < t[0] * len(base | other):
            continue
        frequent = {w: 100 + w for w in range(30)} if rng.random() < 0.7 else {}
        sets = [sorted(x, key=lambda w: (frequent.get(w, 0), w)) for x in (base, other)]
        posts = [{(k, i, packed(len(x), j - i, d, 0)) for k, i, j, d in bucket_keys(x, frequent, None, t)} for x in sets]
        for turn in range(12):
            # meets in a bucket as two rows of no side, or as a left and a right one
            sides = [{(k, how & 3) for k, _, how in p} for p in posts]
            assert any((k, {1: 2, 2: 1, 0: 0}[side]) in sides[1] for k, side in sides[0]), (turn, base, other)
            large = {k for p in posts for k, _, _ in p if hash_all([k, turn]) % 3}  # most buckets are split in each round
            posts = [
                {(key, i, now) for k, i, how in p if k in large for key, now in narrower(k - (1 << 63), r, how, x[i:], t)} | {(k, i, how) for k, i, how in p if k not in large}
                for r, (x, p) in enumerate(zip(sets, posts))
            ]
            if sum(map(len, posts)) > 2_000:
                break


def test_large_buckets_give_the_same_links(spark):
    """A third of the texts share their frequent words; ids are of any sign and size."""
    rng = random.Random(3)
    hot = "the of and to in is it that for on".split()
    texts = [" ".join([*rng.sample(hot, rng.randrange(6, 10)), *(f"w{rng.randrange(30)}" for _ in range(rng.randrange(3)))]) for _ in range(150)]
    texts += [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["w1 " * k + " ".join(hot * 4) + f" z{k}" for k in range(1, 30)]
    ids = [(-1) ** k * ((1 << 62) + 7 * k) for k in range(len(texts))]
    sets = {i: set(words(t)) for i, t in zip(ids, texts)}
    want = sorted((min(a, b), max(a, b)) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) * 4 >= 3 * len(sets[a] | sets[b]) and words(texts[ids.index(a)]) != words(texts[ids.index(b)]))
    df = spark.createDataFrame([(k % 2, i, t) for k, (i, t) in enumerate(zip(ids, texts))], "field int, id long, text string").withColumn("field", F.lit(1))
    sets_df = word_sets(df, set())
    for most in (25, 2_000):
        assert rows(expand_pairs(*link_sets(sets_df, (3, 4), most)), "id_a", "id_b") == want


# mixture (2)


def test_density_from_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    a = rng.normal(size=(2, 3, 3))
    m = Mixture(np.ones(1), np.zeros(1), np.eye(1), np.ones(1), np.array([0.3, 0.7]), rng.normal(size=(2, 3)), a @ a.transpose(0, 2, 1) + np.eye(3))
    for j in range(2):
        z = x - m.centres[j]
        direct = np.log(m.weights[j]) - 0.5 * (3 * np.log(2 * np.pi) + np.linalg.slogdet(m.covariances[j])[1] + np.einsum("ni,ij,nj->n", z, np.linalg.inv(m.covariances[j]), z))
        assert np.allclose(m.log_joint(x)[:, j], direct)


def test_sums_of_many_tasks(spark):
    df = spark.range(1000).repartition(70).select(F.col("id").cast("string").alias("text"))
    assert _sums(df, "text", lambda s: np.array([len(s), sum(map(int, s.to_pylist()))], dtype="f8")).tolist() == [1000, 499500]
    assert _sums(df.limit(0), "text", lambda s: np.ones(1)).tolist() == []


def test_the_criterion_chooses_the_number_of_components(spark):
    rng = random.Random(11)
    topics = [[f"{a}{b}word" for b in ("river", "boat", "fish", "water", "sail")] for a in "abcdef"]
    data = [(k, " ".join(rng.choice(topics[k % 6]) for _ in range(8))) for k in range(1800)]
    _, features, history = fit_mixture(spark.createDataFrame(data, "id long, text string"))
    sizes = dict(history)
    best = min(sizes, key=sizes.get)
    assert 3 <= best <= 12 and 2 * best <= max(sizes) or best * 2 > max(sizes) >= 8
    assert features.count() == 1800 and any(k & (k - 1) for k in sizes)
    _, _, few = fit_mixture(spark.createDataFrame([(1, "one claim here"), (2, "another claim")], "id long, text string"))
    assert max(k for k, _ in few) <= 2
