"""Rules on single texts against golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from parolith.functions import labels as L
from parolith.functions import text as X
from parolith.functions.claims import canonicalise, reduce_wording
from parolith.operators.clusters import claim_score
from parolith.operators.diagnostics import incomplete_beta, spearman_p, trust_score
from parolith.operators.tfidf import adaptive_threshold

GOLDEN = [
    ("It's better to give than to receive", "Better give than receive."), ("Health is better than wealth", "Better Health than wealth."), ("Prefer truth over comfort", "Better truth than comfort."),
    ("Never look back.", "Avoid look back."), ("Can't buy love", "Avoid buy love."), ("It's wrong to steal", "Avoid steal."), ("When it rains, it pours", "If it rains, then it pours."),
    ("Where there's smoke, there's fire.", "If there is smoke, there is fire."), ("If there is smoke, there is fire.", "If there is smoke, then there is fire."),
    ("The early bird catches the worm", "Early action brings worm."), ("Practice makes perfect", "Practice improves skill."), ("Proverb: Many hands make light work", "Cooperation reduces effort."),
    ("Together we stand, divided we fall", "Unity creates strength."), ("Too many cooks spoil the broth", "Excess of cooks harms broth."), ("All work and no play makes Jack a dull boy", "Balance work and rest."),
    ("Haste makes waste.", "Haste causes problems."), ("Slow and steady wins the race", "Consistency beats speed."), ("Good things come to those who wait", "Patience brings rewards."),
    ("A stitch in time – English proverb.", "A stitch in time."), ("Who goes there?", "Who goes there?"), ('" Never lie"', "Never lie."), ("", ""), (None, ""),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("r")).orderBy("k").select("r").collect()]


def test_canonical_claims(spark):
    assert column(spark, [g[0] for g in GOLDEN], canonicalise) == [g[1] for g in GOLDEN]


def test_reduced_wording(spark):
    assert column(spark, ["The man had gold", "Fine women ARE poor!", "café 良薬, done", "", None, "a a the one"], reduce_wording) == ["person have wealth", "good person be bad!", "café 良薬 do", "", "", "person"]


def test_normalise_and_count(spark):
    assert column(spark, ["English  equivalent :  A   b\t", None, "  x　 ", "nan"], X.normalise_text) == ["A b", "", "x", "nan"]
    assert column(spark, ["", "  ", None and "", " one two\nthree "], lambda c: X.word_count(F.coalesce(c, F.lit("")))) == [0, 0, 0, 3]


def test_cleaner_verdicts(spark):
    texts = ["John Smith", "Nice.", "See also the rest", "edit", "jump to top", "ISBN 0-1 is known", "as p. 12 says", "Category:Foo is here", "Category: Foo is here", "Time is money", "良い薬は苦い。", "Jump Over Walls Now"]
    assert column(spark, texts, X.keep_basis) == [False, False, False, False, False, False, False, False, False, True, True, True]
    assert column(spark, ["John Smith", "john smith", "A B C D", "Café O'Neil", "良薬"], X.name_like) == [True, False, False, True, False]


def test_scores_and_filter(spark):
    assert column(spark, ["Avoid haste; practice patience daily.", "abc", ""], X.quality_score) == [6, 0, 0]
    texts = ["Smith (1999). Book.", "word " * 41, "word " * 41 + ".", "early bird", "plain words here", "", "See WorldCat", "References", "Preferences"]
    assert column(spark, texts, X.filter_cascade) == [False, False, True, True, False, False, False, False, False]
    assert column(spark, ["plain words here"], lambda c: X.filter_cascade(c, F.lit(True))) == [True]


def test_labels(spark):
    assert column(spark, ["English", "Thai", "Klingon", None], L.family_of) == ["Germanic", "Tai-Kadai", "Other", "Other"]
    assert column(spark, ["Many hands help", "A wolf never lies", "xyz", None], L.theme_of) == ["Cooperation / Social Support", "Prudence / Risk & Uncertainty", "Other", "Other"]
    assert column(spark, ["Yes, clearly", "No", "what", None], lambda c: L.on_scale(c, L.COHERENCE)) == [5, 1, 3, 3]
    assert column(spark, ["Low", "Med", "High", "x"], L.low_med_high) == [1, 2, 3, None]


def test_claim_score(spark):
    row = spark.range(1).select(claim_score(F.lit("Avoid haste in all things today."), F.lit(4), F.lit(5), F.lit(3)).alias("s")).first()
    assert row["s"] == 7.8


@pytest.mark.parametrize("s, c, t, score", [(0.25, 0.4, 1.0, 6.0), (None, None, 1.0, 3.0), (float("nan"), float("nan"), 1.0, 3.0), (1.0, 0.0, 1.0, 10.0), (-1.0, 2.0, 0.0, 0.0)])
def test_trust(spark, s, c, t, score):
    df = spark.createDataFrame([(s, c, t)], "s double, c double, t double")
    assert df.select(trust_score(F.col("s"), F.col("c"), F.col("t"))).first()[0] == score


def test_threshold_bands():
    assert (adaptive_threshold(49, None), adaptive_threshold(501, None)) == (0.25, 0.45)
    assert adaptive_threshold(100, 0.4) == 0.35 * 0.8 and adaptive_threshold(100, 0.05) == 0.35 * 1.2 and adaptive_threshold(100, 0.2) == adaptive_threshold(100, None) == 0.35


def test_p_values():
    assert abs(incomplete_beta(0.5, 2, 3) - 0.6875) < 1e-9 and incomplete_beta(1, 2, 2) == 1
    t = 2.0
    rho = t / math.sqrt(t * t + 10)
    assert abs(spearman_p(rho, 12) - 0.07338803) < 1e-6 and spearman_p(1, 5) == 0
