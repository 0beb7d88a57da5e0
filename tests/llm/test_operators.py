"""Operators on small fixtures: brute force, edge cases, and the defined results of nulls, blanks, ties and empty tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from parolith.llm import textforms
from parolith.llm.p01_language import choose_languages, fit_grams, Identifier, identify, language_of_label, mixture
from parolith.llm.p02_clusters import alike_clusters, describe_clusters, gaussian_clusters, long_words
from parolith.llm.p03_near import SetTrie, bucket_keys, expand_pairs, near_copies, near_groups, need
from parolith.llm.p04_copies import find_copies
from parolith.llm.p05_main_body import judge_lines, main_bodies
from parolith.llm.p06_entries import EntryTrie, map_entries
from parolith.llm.p07_forms import find_forms, normalise_forms
from parolith.llm.p08_packing import best_boundaries, fill_report, pack
from parolith.llm.p09_mixing import mix
from parolith.llm.p10_sentences import sentences, split_sentences

#: Names that operators use inside; as extra columns they must not disturb.
CLASH = "field string, text2 string, seq long, words string, n long, host string, key string, bucket int, source2 string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# forms (7)


@pytest.mark.parametrize("text, form", [
    ("plain text", "plain text"), ("gｏｌｄen", "golden"), ("no break", "no break"), ("zero​width", "zerowidth"), ("é", "é"), ("reаched", "reached"), ("знaют", "знают"),
    ("Веttеr а gеntlе mіrrоr", "Better a gentle mirror"), ("ﬁne", "fine"), ("⽇头", "日头"), ("خیر", "خير"), ("أ".replace("أ", "أ"), "أ"), ("ガ".replace("ガ", "ガ"), "ガ"),
])
def test_one_form(text, form):
    assert textforms.one_form(text) == form
    assert textforms.one_form(form) == form


@pytest.mark.parametrize("text", ["น้ำ", "हिन्दी", "क्‍ष", "Кто верит Rome, тот", "“quoted” – dash…", "，。「」", "a\tb\nc", "ırmak", "", "   ", "日本　語"])
def test_usual_forms_are_no_case(text):
    assert not textforms.is_case(text)


def test_find_forms(spark):
    df = spark.createDataFrame([(1, "ok", None, "x"), (2, "ｗide", "so­ft", None), (2, "ｗide", "", None), (None, "ｗ", "", ""), (4, "a" * 50000 + "​", " ", "")], "row_id long, saying string, original string, field string")
    assert rows(find_forms(df, "row_id", ["saying", "original"]), "row_id", "field") == [(2, "original"), (2, "saying"), (2, "saying"), (4, "saying")]
    assert rows(normalise_forms(df, ["saying"]).where("row_id = 2"), "saying_form") == [("wide",), ("wide",)]
    assert find_forms(df.limit(0), "row_id", ["saying"]).count() == 0


# words and copies (4)


def test_words_fold_every_script():
    assert textforms.words("C'est—la VIE! STRASSE straße İ ı") == ["c", "est", "la", "vie", "strasse", "strasse", "i", "i"]
    assert textforms.words(None) == textforms.words(" … ") == []


def test_copies(spark):
    data = [(5, "A word.", "Two"), (3, "a  WORD", "two!"), (9, "two", "a word"), (7, "a word", None), (8, "A word", " "), (1, None, "a"), (2, " ", "a"), (10, "aword", None), (11, "drow a", None), (12, "а word", "two")]
    df = spark.createDataFrame([(*r, "z", 1) for r in data], "row_id long, saying string, eq string, key string, n int")
    copies, groups = find_copies(df, "row_id", "saying", "eq")
    assert rows(copies, "first_id", "id") == [(3, 5), (3, 9), (7, 8)]
    assert rows(groups, "first_id", "n_copies") == [(3, 3), (7, 2)]
    assert find_copies(df.limit(0), "row_id", "saying", "eq")[0].count() == 0


# near copies (3), alike claims (2)


def brute_pairs(sets, t):
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and len(x & y) * t[1] >= t[0] * len(x | y)}


@pytest.mark.parametrize("t", [(3, 4), (4, 5), (2, 5), (1, 2)])
def test_bucket_keys_lose_no_pair(t):
    rng = random.Random(sum(t))
    for _ in range(400):
        frequent = {w: 100 + w for w in range(30)} if rng.random() < 0.8 else {}
        base = [rng.randrange(60) for _ in range(rng.choice((1, 2, 3, 5, 9, 20, 40)))]
        other = [w if rng.random() < 0.85 else rng.randrange(60) for w in base] + [rng.randrange(60) for _ in range(rng.randrange(3))]
        a, b = set(base), set(other)
        order = lambda s: sorted(s, key=lambda w: (frequent.get(w, 0), w))
        if len(a & b) * t[1] >= t[0] * len(a | b):
            assert {k for k, *_ in bucket_keys(order(a), frequent, None, t)} & {k for k, *_ in bucket_keys(order(b), frequent, None, t)}, (a, b)


def test_trie_finds_what_pairs_find():
    rng = random.Random(4)
    for _ in range(60):
        t = rng.choice([(3, 4), (2, 5)])
        sets = [tuple(sorted({rng.randrange(14) for _ in range(rng.randrange(1, 9))})) for _ in range(30)]
        trie, found = SetTrie(), set()
        for i, s in enumerate(sets):
            found |= {(j, i) for j in trie.partners(len(s), s, t)}
            trie.add(i, len(s), s)
        assert found == {(j, i) for i, s in enumerate(sets) for j in range(i) if len(set(s) & set(sets[j])) >= need(len(s), len(sets[j]), t)}


def test_near_copies(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts += [t.upper() for t in texts[:20]] + [" ".join(t.split()[::-1]) for t in texts[20:40]] + [t + " extra" for t in texts[40:80]] + ["x " * 3000, "x " * 3000 + "y"]
    data = [(k % 2, k, t) for k, t in enumerate(texts)] + [(0, 900, None), (0, 901, "  "), (1, 902, "…")]
    links, members = near_copies(spark.createDataFrame(data, "field int, id long, text string"), (3, 4))
    links, members = links.cache(), members.cache()
    got = rows(expand_pairs(links, members), "field", "id_a", "id_b")
    want = set()
    for field in (0, 1):
        mine = [(i, textforms.words(t)) for f, i, t in data if f == field]
        for a, b in brute_pairs([(i, set(w)) for i, w in mine], (3, 4)):
            if dict(mine)[a] != dict(mine)[b]:
                want.add((field, min(a, b), max(a, b)))
    assert got == sorted(want)
    groups = rows(near_groups(links, members), "field", "id", "group_id")
    assert {(f, i) for f, i, _ in groups} == {(f, i) for f, a, b in want for i in (a, b)}


def test_alike_claims(spark):
    rng = random.Random(2)
    words = [f"longword{chr(97 + k)}{chr(97 + k % 7)}" for k in range(26)]
    claims = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) + " tiny" for _ in range(60)] + ["short only", ""]
    df = spark.createDataFrame([(k, c, "x") for k, c in enumerate(claims)] + [(99, None, "x")], "ord long, claim string, words string")
    parent = {k: k for k in range(len(claims))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in brute_pairs([(k, long_words(c)) for k, c in enumerate(claims)], (2, 5)):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert rows(alike_clusters(df, "ord", "claim"), "first_id", "id") == sorted((root(k), k) for k in parent if root(k) != k)
    assert alike_clusters(df.limit(0), "ord", "claim").count() == 0


def test_gaussian_clusters(spark):
    rng = random.Random(3)
    topics = [["river", "boat", "fish", "water", "sail"], ["bread", "oven", "flour", "baker", "crust"]]
    data = [(k, " ".join(rng.choice(topics[k % 2]) + "s" for _ in range(6)), "n") for k in range(300)] + [(400, None, "n"), (401, " ", "n")]
    df = spark.createDataFrame(data, "ord long, claim string, cluster string")
    made = gaussian_clusters(df, "ord", "claim", most=8).cache()
    assert made.count() == 300
    by = collections.defaultdict(collections.Counter)
    for r in made.collect():
        by[r["cluster"]][r["id"] % 2] += 1
    assert sum(max(c.values()) for c in by.values()) >= 0.95 * 300
    told = describe_clusters(made, 3).collect()
    assert sum(r["size"] for r in told) == 300 and all(len(r["typical_ids"]) == min(3, r["size"]) for r in told)
    assert gaussian_clusters(df.limit(0), "ord", "claim").count() == 0


# languages (1)

TRAINING = {
    "en": ["the bridge is old and the miller knows it", "who lends the boat will ask for it again", "never trust the miller with the bread"],
    "es": ["el puente es viejo y el molinero lo sabe", "quien presta la barca la vuelve a pedir", "nunca fies el pan al molinero"],
    "ru": ["мост стар и мельник это знает", "кто даёт лодку тот её попросит"],
}


def model():
    texts, labels = zip(*[(t, k) for k, ts in TRAINING.items() for t in ts * 3])
    return fit_grams(list(texts), list(labels))


@pytest.mark.parametrize("label, code", [("en-GB", "en"), ("English", "en"), ("DE", "de"), ("zho", "zh"), ("pt_BR", "pt"), ("unknown", None), ("??", None), ("", None), (None, None)])
def test_labels(label, code):
    assert language_of_label(label) == code


def test_identifier_and_stretches():
    found = Identifier(model())(["the bridge is old", "el puente es viejo", "", "123", "the miller knows it and the bread is old. el molinero lo sabe y la barca es el puente viejo", "мост стар"])
    assert [[s[0] for s in f] for f in found] == [["en"], ["es"], [], [], ["en", "es"], ["ru"]]
    assert all(0 <= s[1] <= 1 for f in found for s in f)


def test_em_proportions():
    import numpy as np

    score = np.log(np.array([[0.9, 0.1]] * 6 + [[0.1, 0.9]] * 3))
    share, _ = mixture(score, np.zeros(9, dtype=int), 1, np.ones((1, 2)), rounds=200)
    assert share[0, 0] > share[0, 1] and abs(share.sum() - 1) < 1e-9
    assert choose_languages(score.astype("f4"), np.zeros(9, dtype=int), 1).sum() == 1


def test_identify(spark):
    df = spark.createDataFrame([(1, "the bridge is old", "es", "a"), (2, "the bridge is old", "English", "b"), (3, None, None, "c"), (4, " ", "en", "d"), (5, "el puente es viejo", None, "e"), (None, "the bridge", "en", "f")], "row_id long, saying string, saying_lang string, lang string")
    got = rows(identify(df, "row_id", [("saying", "saying_lang")], model(), cases_only=True), "id", "seg", "lang")
    assert got == [(1, 0, "en"), (5, 0, "es")]
    assert identify(df.limit(0), "row_id", [("saying", "saying_lang")], model()).count() == 0


def test_held_out_accuracy():
    """Trained on half of the template sentences with noise in the labels, tested on the rest."""
    rng = random.Random(0)
    texts, labels = [], []
    for code, ts in TRAINING.items():
        for _ in range(80):
            ws = rng.choice(ts).split()
            rng.shuffle(ws)
            texts.append(" ".join(ws[:6]) + f" N{rng.randrange(10**6)}ovarix")
            labels.append(code)
    noisy = [x if rng.random() > 0.1 else "en" for x in labels]
    grams = fit_grams(texts[::2], noisy[::2])
    got = Identifier(grams)(texts[1::2])
    assert sum(g[0][0] == y for g, y in zip(got, labels[1::2])) >= 0.97 * len(got)


# main bodies (5)


def pages(spark):
    data = []
    for k in range(30):
        own = chr(97 + k % 26) * 3 + chr(97 + k // 26)
        main = f"People{k % 3} proverbs\nNobody from {own} shares a boat.\nSome in {own} say so."
        data.append((k, f"https://site.example/p/People{k % 3}/{k}", f"People{k % 3}", f"Home | About\nWe use cookies. Accept.\n{main}\nMost read\nThe mill of Oran never sleeps.\n© {2000 + k} site.example. All rights reserved."))
    data += [(50, "https://lone.example/p/Solo/1", None, "menu on\nSolo: collected lines\n\nA lone line stands.\nclose menu"), (51, None, None, None), (52, "https://lone.example/x/9", "Nobody", "menu on"), (53, None, None, "text without an address.")]
    return spark.createDataFrame(data, "page_id long, source_url string, people string, saying string").withColumn("host", F.lit("clash"))


def test_main_bodies(spark):
    df = pages(spark)
    kept = rows(judge_lines(df, "page_id", "source_url", "people", "saying").where("main"), "page", "line_no")
    assert kept == sorted([(k, n) for k in range(30) for n in (2, 3, 4)] + [(50, 1), (50, 3)])
    bodies = {r["page"]: r["body"] for r in main_bodies(df, "page_id", "source_url", "people", "saying").collect()}
    assert bodies[50] == "Solo: collected lines\nA lone line stands." and bodies[52] == "" and 51 not in bodies
    assert judge_lines(df.limit(0), "page_id", "source_url", "people", "saying").count() == 0


# entries (6)

ENTRIES = ["Upper Velzarish", "Lower Velzarish", "Velzarish", "English", "Thai", "Korlumolo"]


@pytest.mark.parametrize("value, entry", [
    ("english", "English"), ("Engsish", "English"), ("the Thai", "Thai"), ("Tiai", "Thai"), ("Velzarish (upper)", "Upper Velzarish"), ("Velzarish, Lower", "Lower Velzarish"), ("Up. Velzarish", "Upper Velzarish"),
    ("KORLUMOOLO people", "Korlumolo"), ("Korlumolô", "Korlumolo"), ("unknown", ""), ("?", ""), ("Korithmaric", ""), ("[English]", "English"), ("Englishs", "English"), ("Englsih folk sayings", "English"),
])
def test_entries(value, entry):
    assert EntryTrie(ENTRIES).best(value)[0] == entry


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 11))) for _ in range(40)]
    trie = EntryTrie(names, (), ())
    from parolith.llm.p06_entries import allowance

    for _ in range(200):
        value = "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 11)))
        want = {}
        for e in set(names):
            d = min(osa(p, value) for p in (e, e + "s"))
            if d <= allowance(len(e)):
                want[e] = d
        assert trie.search(value) == want


def test_map_entries(spark):
    df = spark.createDataFrame([(1, "English", "a"), (2, "Engsish", "b"), (3, None, "c"), (4, "  ", "d"), (5, "zzzz", "e"), (6, "x" * 20000, "f")], "row_id long, people string, value string")
    ref = spark.createDataFrame([(e,) for e in [*ENTRIES, "English", None, " "]], "people string")
    assert rows(map_entries(df, "row_id", "people", ref, "people", keep_exact=False), "id", "entry") == [(2, "English"), (5, ""), (6, "")]
    assert map_entries(df, "row_id", "people", ref, "people").count() == 4
    assert rows(map_entries(df, "row_id", "people", ref.limit(0), "people"), "entry") == [("",)] * 4
    with pytest.raises(ValueError):
        map_entries(df, "row_id", "people", ref, "people", max_entries=3)


# packing (8)


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(8)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)
        got = best_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        assert len(got) <= k and padding(lengths, counts, got) == best


def test_pack(spark):
    rng = random.Random(9)
    docs = [(k, " ".join("word" for _ in range(rng.choice((3, 20, 90, 200, 700)))), k) for k in range(300)] + [(900, None, 1), (901, "", 1), (902, " ", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens int")
    specs = spark.createDataFrame([(1, 128), (2, 1000), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    packed = pack(df, "doc_id", "text", specs, "spec_id", "capacity_tokens", buckets=4).cache()
    for spec, cap in ((1, 128), (2, 1000)):
        mine = packed.where(F.col("spec") == spec).collect()
        room, whole = collections.Counter(), collections.defaultdict(list)
        for r in mine:
            room[r["container"]] += r["n_tokens"]
            whole[r["id"]].append((r["start_token"], r["n_tokens"]))
        assert max(room.values()) <= cap and sorted(room) == list(range(len(room)))
        for parts in whole.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and (len(parts) == 1 or all(n == cap for _, n in parts[:-1]))
    report = {r["spec"]: r for r in fill_report(packed).collect()}
    assert set(report) == {1, 2} and report[2]["filled"] > 0.9
    assert pack(df.limit(0), "doc_id", "text", specs, "spec_id", "capacity_tokens").count() == 0


# mixing (9)


def test_mix(spark):
    docs = [(k, "word " * 20, "big") for k in range(600)] + [(1000 + k, "word " * 20, "small") for k in range(20)] + [(5000, None, "big"), (5001, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "big", 0.6, 1), (1, "small", 0.3, 4), (1, "absent", 0.1, 2), (2, "big", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    out, shares = mix(df, "doc_id", "text", "source", targets)
    by = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    assert abs(by[1, "big"]["actual_share"] - 2 / 3) < 0.01 and by[1, "small"]["turns"] == 4 and by[1, "absent"]["actual_share"] == 0
    got = out.collect()
    copies = collections.Counter((r["mix_id"], r["source"], r["id"]) for r in got)
    assert max(v for k, v in copies.items() if k[:2] == (1, "small")) == 4 and max(v for k, v in copies.items() if k[1] == "big") == 1
    first = [r["source"] for r in sorted((r for r in got if r["mix_id"] == 1), key=lambda r: r["finish"])][:60]
    assert 35 <= first.count("big") <= 45
    assert mix(df.limit(0), "doc_id", "text", "source", targets)[0].count() == 0
    few, told = mix(df, "doc_id", "text", "source", targets, budget=500)
    assert 400 <= sum(r["used_tokens"] for r in told.where("mix_id = 2").collect()) <= 600


# sentences (10)


@pytest.mark.parametrize("text, parts", [
    ("Dr. A. Smith came. He left.", ["Dr. A. Smith came.", "He left."]),
    ('She said: "Wait. It comes." and left. Then?', ['She said: "Wait. It comes." and left.', "Then?"]),
    ("It costs 9.9 crowns, i.e. less. See fig. 7.2 in vol. 3.", ["It costs 9.9 crowns, i.e. less.", "See fig. 7.2 in vol. 3."]),
    ("A heading\nThe text goes on. And on.", ["A heading", "The text goes on.", "And on."]),
    ("奶奶说：“等一等。公鸡会来的。”然后关上了门。好！", ["奶奶说：“等一等。公鸡会来的。”然后关上了门。", "好！"]),
    ("祖母は「待ちなさい。来る。」と言った。古い。", ["祖母は「待ちなさい。来る。」と言った。", "古い。"]),
    ("ใครเชื่ออย่าถาม เด็กๆ ยังท่อง", ["ใครเชื่ออย่าถาม", "เด็กๆ ยังท่อง"]),
    ("यह सच है। और यह भी।", ["यह सच है।", "और यह भी।"]),
    ("Дети называют лес и т. д. Чей он?", ["Дети называют лес и т. д.", "Чей он?"]),
    ("Am 3. März kam er, z. B. heute. Gut.", ["Am 3. März kam er, z. B. heute.", "Gut."]),
    ("Bread, salt... and wine. What?! Yes", ["Bread, salt... and wine.", "What?!", "Yes"]),
    ("", []), ("  \n ", []), (None, []),
])
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_sentences_cover_all_but_blanks():
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice("aA b.B?!\n\"'()«»“”。「」1ก ๆ") for _ in range(rng.randrange(80)))
        spans = sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        inside = set(i for a, b in spans for i in range(a, b))
        assert all(text[i].isspace() for i in range(len(text)) if i not in inside)
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "One. Two.", 5), (2, None, 5), (3, " ", 5), (4, "Same. " * 20000, 5), (1, "One. Two.", 5)], "doc_id long, text string, seq int")
    got = split_sentences(df, "doc_id", "text")
    assert rows(got.where("id = 1"), "start_pos", "end_pos") == [(0, 4), (0, 4), (5, 9), (5, 9)]
    assert got.where("id = 4").count() == 20000 and got.count() == 20004
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0
