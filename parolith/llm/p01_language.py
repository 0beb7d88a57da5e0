"""Problem 1: the language of every text and of every stretch of a mixed one, with a confidence.

Method: multilingual mixture inference. A word has a likelihood under each language from its character n-grams. A text is
a mixture of languages: expectation-maximisation estimates its proportions, and the set of languages is chosen by
penalised likelihood, adding the language of the greatest gain while it exceeds the penalty. A Viterbi pass over the chosen
languages then gives the stretches; changing language is cheap at a mark that ends or parts sentences only. Three bounds save
work and change no answer. No mixture gains more than what the best language leaves to the best score of each word. A path with
s changes has at most s + 1 stretches in other languages, so it gains nothing if no run of words gains half the cost of a change over
the best language. And adding a language to a mixture gains at most N log(g / N) over N words, g being the sum of its likelihoods
relative to the mixture's (Jensen's inequality), so a language below the penalty is not tried.

The n-gram model is fitted on a bounded sample of labelled rows (``SAMPLE_TEXTS``, taken by a hash of the id). Wrong
labels are outvoted: the sample is labelled again by the model and the model fitted again, ``REFITS`` times.
Names belong to no language: a word that the sample holds in a few texts at most can say little for or against one, and
hardly counts in the fit. The confidence is the posterior of the language; n-grams count a third each because three lie over a
character, which keeps it honest: on held-out texts cut to a few words it agrees with the share of right answers.

Scoring is one narrow pass without a shuffle; what goes to the workers is the model, ``TABLE * languages`` floats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import not_blank, quoted, with_id
from parolith.llm.textforms import one_form

LANGUAGES = tuple("en es fr de it pt nl tr ru ar hi th zh ja".split())
#: Spellings of labels besides the two-letter code (three letters, English and own names).
LABELS = {
    "en": "eng english", "es": "spa spanish castilian español", "fr": "fra fre french français", "de": "deu ger german deutsch",
    "it": "ita italian italiano", "pt": "por portuguese português", "nl": "nld dut dutch flemish nederlands", "tr": "tur turkish türkçe",
    "ru": "rus russian русский", "ar": "ara arabic arb العربية", "hi": "hin hindi हिन्दी", "th": "tha thai ไทย",
    "zh": "zho chi cmn chinese mandarin 中文", "ja": "jpn japanese 日本語",
}
_NAMED = {w: code for code, ws in LABELS.items() for w in [code, *ws.split()]}

SAMPLE_TEXTS = 24_000
REFITS = 2
TABLE = 1 << 16
FLOOR = 1e-5
WIDESPREAD, RARE_WEIGHT = 3, 0.003
WORD_FLOOR, UNKNOWN_FLOOR = 7.0, 1.2
PENALTY = 9.0
SWITCH_AT_MARK, SWITCH_INSIDE = 6.0, 14.0
ROUNDS = 12

#: Words; in scripts without blanks single characters (Han, kana) or short pieces (Thai, Lao, Khmer, Burmese).
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff々]|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{1,3}|[^\W\d_](?:[^\W\d_]|[̀-ͯ҃-ً҇-ٰٟऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎])*")
_MARK = re.compile(r"[.!?;:…。！？।؟\n|/()—«»“”「」\"]")


def language_of_label(label: str | None) -> str | None:
    """The two-letter code a label denotes, in whatever spelling; None if it is missing or names no known language."""
    if not isinstance(label, str):
        return None
    word = re.split(r"[-_\s(]", label.strip().lower(), maxsplit=1)[0]
    return _NAMED.get(word)


@dataclass
class Grams:
    """Log likelihoods of hashed character n-grams, one column per language."""

    table: np.ndarray
    known: frozenset[str] = frozenset()

    def words(self, tokens: Sequence[str]) -> np.ndarray:
        """One row per word: log likelihood under each language, the best at 0, none below -WORD_FLOOR."""
        if not tokens:
            return np.zeros((0, self.table.shape[1]), dtype="f4")
        slots, starts = gram_slots(tokens)
        score = np.add.reduceat(self.table[slots], starts, axis=0)
        score -= score.max(axis=1, keepdims=True)
        floor = np.array([WORD_FLOOR if t in self.known or len(t) == 1 else UNKNOWN_FLOOR for t in tokens], dtype="f4")
        return np.maximum(score, -floor[:, None])


def gram_slots(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all bigrams to tetragrams of the padded words, and the place where each word's begin."""
    padded = "".join(f"\x02{t}\x03" for t in tokens)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("u8")
    ends = np.flatnonzero(codes == 3)
    begins = np.concatenate(([0], ends[:-1] + 1)).astype("i8")
    lengths = ends - begins + 1
    which = np.repeat(np.arange(len(begins)), lengths)
    parts, owners = [], []
    h = codes.copy()
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint64(0x9E3779B1) + codes[n - 1 :]) & np.uint64(0xFFFFFFFFFFFF)
        inside = which[: len(h)] == which[n - 1 :]
        mixed = (h * np.uint64(n * 2 + 1)) & np.uint64(0xFFFFFFFFFFFF)
        parts.append(((mixed ^ (mixed >> np.uint64(17))) % np.uint64(TABLE))[inside])
        owners.append(which[: len(h)][inside])
    slots, owner = np.concatenate(parts).astype("i8"), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return slots[order], np.searchsorted(owner, np.arange(len(begins)))


def fit_grams(texts: Sequence[str], labels: Sequence[str], languages: Sequence[str] = LANGUAGES, refits: int = REFITS) -> Grams:
    """Fits the model on labelled texts; wrong labels lose their say when the model labels the texts again."""
    split = [tokens_of(t) for t in texts]
    vocabulary = sorted({w for ws in split for w in ws})
    place = {w: k for k, w in enumerate(vocabulary)}
    k = len(languages)
    if not vocabulary:
        return Grams(np.zeros((TABLE, k), dtype="f4"))
    slots, starts = gram_slots(vocabulary)
    counts_per_word = np.diff(np.append(starts, len(slots)))
    owner = np.repeat(np.arange(len(vocabulary)), counts_per_word)
    code = {name: i for i, name in enumerate(languages)}
    now = np.array([code.get(x, -1) for x in labels])
    flat = np.array([place[w] for ws in split for w in ws], dtype="i8")
    text = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
    grams = Grams(np.zeros((TABLE, k), dtype="f4"))
    # words of a few texts are mostly names, which belong to no language
    spread = np.bincount(np.unique(np.stack([text, flat]), axis=1)[1], minlength=len(vocabulary)) >= WIDESPREAD
    weight = np.where(spread, 1.0, RARE_WEIGHT)
    for turn in range(refits + 1):
        known = now[text] >= 0
        uses = np.bincount(flat[known] * k + now[text][known], minlength=len(vocabulary) * k).reshape(-1, k) * weight[:, None]
        counts = np.stack([np.bincount(slots, weights=(uses[:, j] ** 0.75)[owner], minlength=TABLE) for j in range(k)], axis=1)
        chance = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1)
        # one floor for all languages: n-grams that none knows say nothing. The three n-grams over a character count a third each
        grams = Grams((np.log(chance + FLOOR) / 3).astype("f4"), frozenset(w for w, s in zip(vocabulary, spread) if s))
        if turn < refits:
            per_word = grams.words(vocabulary)
            total = np.stack([np.bincount(text, weights=per_word[flat, j], minlength=len(split)) for j in range(k)], axis=1)
            best = total.argmax(axis=1)
            sure = np.sort(total, axis=1)[:, -1] - np.sort(total, axis=1)[:, -2] > 4 if k > 1 else np.ones(len(split), bool)
            has = np.bincount(text, minlength=len(split)) > 0
            now = np.where(has & sure, best, now)
    return grams


def posterior(total: np.ndarray) -> np.ndarray:
    """The chance of each language (last axis) from log likelihoods."""
    p = np.exp(total - total.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def tokens_of(text: str) -> list[str]:
    """The words of a text, lower case and in one form."""
    return _WORD.findall(one_form(text).lower())


def marks_of(text: str) -> np.ndarray:
    """Whether a mark stands before each of these words."""
    t = one_form(text).lower()
    marks, at = [], 0
    for m in _WORD.finditer(t):
        marks.append(at == 0 or _MARK.search(t, at, m.start()) is not None)
        at = m.end()
    return np.array(marks, dtype=bool)


def mixture(score: np.ndarray, owner: np.ndarray, n: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once: proportions (n x languages) over the allowed languages, and the log likelihood of each text."""
    per_text = (allowed > 0).sum(axis=1)
    if len(per_text) and per_text.min() == per_text.max() < allowed.shape[1]:  # sets of one size: no other column is looked at
        langs = np.nonzero(allowed > 0)[1].reshape(n, -1)
        few, log = mixture(score[np.arange(len(owner))[:, None], langs[owner]], owner, n, np.ones(langs.shape), rounds)
        share = np.zeros(allowed.shape)
        np.put_along_axis(share, langs, few, axis=1)
        return share, log
    share = allowed / allowed.sum(axis=1, keepdims=True)
    likely = np.exp(score)
    size = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    starts = np.searchsorted(owner, np.arange(n))
    for _ in range(rounds):
        joint = likely * share[owner]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, starts, axis=0) / size
    log = np.log(np.maximum((likely * share[owner]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(log, starts)


def choose_languages(score: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The language set of each text (n x languages, bool): single best, then one more while the gain exceeds the penalty.

    Every text must have a word; owner rises.
    """
    k = score.shape[1]
    starts = np.searchsorted(owner, np.arange(n))
    total = np.add.reduceat(score, starts, axis=0)
    best = total.argmax(axis=1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    # the best score of a word is 0, so no mixture can gain more than what the best language leaves
    open_ = -total[np.arange(n), best] > PENALTY
    # nor can stretches pay for the changes between them unless some run of words gains half a change over the best language
    rows = np.flatnonzero(open_[owner])
    if len(rows):
        own = owner[rows]
        step = (score[rows] - score[rows, best[own]][:, None]).astype("f8")
        apart = own[:, None] * (WORD_FLOOR * (2 * len(rows) + 2))  # each text lies below the one before it
        run = np.cumsum(step, axis=0) - apart
        gain = (run - np.minimum.accumulate(run - step)).max(axis=1)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        open_[own[first]] = np.maximum.reduceat(gain, first) > SWITCH_AT_MARK / 2
    open_ = np.flatnonzero(open_)
    if not len(open_):
        return chosen
    renumber = np.full(n, -1)
    renumber[open_] = np.arange(len(open_))
    rows = np.flatnonzero(renumber[owner] >= 0)
    sub, own = score[rows].astype("f8"), renumber[owner[rows]]
    now = total[open_, best[open_]].astype("f8")
    sets = chosen[open_].copy()
    share = sets.astype("f8")  # what the words of a text have of each language so far
    alive = np.arange(len(open_))
    while len(alive):
        renum = np.full(len(open_), -1)
        renum[alive] = np.arange(len(alive))
        r = np.flatnonzero(renum[own] >= 0)
        s, o = sub[r], renum[own[r]]
        size = np.bincount(o, minlength=len(alive)).astype("f8")
        likely = np.exp(s)
        relative = likely / np.maximum((likely * share[alive][o]).sum(axis=1, keepdims=True), 1e-30)
        sums = np.add.reduceat(relative, np.searchsorted(o, np.arange(len(alive))), axis=0)
        inside = np.where(sets[alive], sums, 0.0).max(axis=1, keepdims=True)
        most = size[:, None] * np.log(np.maximum(np.maximum(sums, inside), 1e-30) / size[:, None])
        most = np.where(sets[alive], -np.inf, most)
        order = np.argsort(-most, axis=1, kind="stable")
        gain, more, more_share = np.full(len(alive), PENALTY), np.full(len(alive), -1), share[alive].copy()
        for rank in range(k - 1):
            lang = order[:, rank]
            trial = np.flatnonzero(most[np.arange(len(alive)), lang] > gain)  # the others can't do better than what they have
            if not len(trial):
                break
            rr = np.full(len(alive), -1)
            rr[trial] = np.arange(len(trial))
            pick = np.flatnonzero(rr[o] >= 0)
            allowed = sets[alive[trial]].copy()
            allowed[np.arange(len(trial)), lang[trial]] = True
            got, log = mixture(s[pick], rr[o[pick]], len(trial), allowed.astype("f8"))
            better = log - now[alive[trial]] > gain[trial]
            gain[trial[better]] = (log - now[alive[trial]])[better]
            more[trial[better]], more_share[trial[better]] = lang[trial[better]], got[better]
        take = more >= 0
        sets[alive[take], more[take]] = True
        now[alive[take]] += gain[take]
        share[alive[take]] = more_share[take]
        alive = alive[take]
    chosen[open_] = sets
    return chosen


def stretches(score: np.ndarray, marks: np.ndarray, languages: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first word, end) of the longest stretches in one language, by Viterbi over the chosen languages."""
    s = score[:, languages].astype("f8")
    n, k = s.shape
    back = np.zeros((n, k), dtype="i4")
    now = s[0].copy()
    for i in range(1, n):
        cost = SWITCH_AT_MARK if marks[i] else SWITCH_INSIDE
        top = int(now.argmax())
        jump = now[top] - cost
        back[i] = np.where(now >= jump, np.arange(k), top)
        now = np.maximum(now, jump) + s[i]
    path = [int(now.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out, at = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[at]:
            out.append((int(languages[path[at]]), at, i))
            at = i
    return out


class Identifier:
    """Scores batches of texts on a worker; words met before are looked up."""

    def __init__(self, grams: Grams, languages: Sequence[str] = LANGUAGES):
        self.grams, self.languages = grams, np.array(languages)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), dtype="f4")

    def _ids(self, lists: list[list[str]]) -> np.ndarray:
        if len(self.place) > 400_000:
            self.place, self.scores = {}, self.scores[:0]
        place, fresh = self.place, []
        for ws in lists:
            for w in ws:
                if w not in place:
                    place[w] = len(place)
                    fresh.append(w)
        if fresh:
            self.scores = np.concatenate([self.scores, self.grams.words(fresh)])
        return np.fromiter((place[w] for ws in lists for w in ws), dtype="i8", count=sum(map(len, lists)))

    def __call__(self, texts: Sequence[str]) -> list[list[tuple[str, float, int]]]:
        """For each text its stretches as (language, confidence, words); none for a text without a letter."""
        split = [tokens_of(t) for t in texts]
        out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
        have = [i for i, ws in enumerate(split) if ws]
        if not have:
            return out
        lists = [split[i] for i in have]
        lengths = np.array([len(ws) for ws in lists])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        score = self.scores_of(lists)
        owner = np.repeat(np.arange(len(have)), lengths)
        chosen = choose_languages(score, owner, len(have))
        total = np.add.reduceat(score, starts, axis=0).astype("f8")
        sure = posterior(total).max(axis=1)
        top = self.languages[total.argmax(axis=1)]
        several = chosen.sum(axis=1) > 1
        for d, i in enumerate(have):
            if not several[d]:
                out[i] = [(str(top[d]), float(sure[d]), int(lengths[d]))]
                continue
            a, b = starts[d], starts[d] + lengths[d]
            for lang, x, y in stretches(score[a:b], marks_of(texts[i]), np.flatnonzero(chosen[d])):
                part = posterior(score[a + x : a + y].sum(axis=0, dtype="f8"))
                out[i].append((str(self.languages[lang]), float(part[lang]), y - x))
        return out

    def scores_of(self, lists: list[list[str]]) -> np.ndarray:
        ids = self._ids(lists)
        return self.scores[ids]


def sample_labelled(df: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, label): at most that many rows with a label, taken by a hash of the id.

    Labelled rows beyond twice the number needed are passed over by their hash first, so what all tasks send together is bounded
    too; where few rows have a label all of these are taken.
    """
    rows = df.select(quoted(text_col).cast("string").alias("text"), quoted(label_col).cast("string").alias("label"), F.xxhash64(quoted(id_col)).alias("h")).where(not_blank("text") & not_blank("label"))
    share = min(1.0, 2.0 * most / max(rows.count(), 1))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    return rows.orderBy("h").limit(most).select("text", "label")


def fit_language_model(samples: Sequence[DataFrame], languages: Sequence[str] = LANGUAGES) -> Grams:
    got = pd.concat([s.toPandas() for s in samples], ignore_index=True)
    labels = got["label"].map(language_of_label)
    keep = labels.notna()
    return fit_grams(got["text"][keep].tolist(), labels[keep].tolist(), languages)


_OUT = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("id", T.LongType()), T.StructField("seg", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("n_words", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("is_case", T.BooleanType()),
])


def identify(df: DataFrame, id_col: str, fields: Sequence[tuple[str, str]], grams: Grams, languages: Sequence[str] = LANGUAGES, cases_only: bool = False) -> DataFrame:
    """(field, id, seg, lang, confidence, n_words, label, is_case): one row per stretch of every text; fields are (text column, label column).

    label is the code the row's label denotes, null if it is missing or names none; is_case tells a text whose label is
    missing or denotes another language, or that mixes languages. Null and blank texts, and texts without a letter, give no row.
    Texts are read whole; equal texts in two fields of a row are scored once; other columns take no part.
    """
    shared = df.sparkSession.sparkContext.broadcast((grams, tuple(languages)))  # TABLE * languages floats
    names = [f[0] for f in fields]
    picked = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), *[quoted(c).cast("string").alias(f"{p}{k}") for k, f in enumerate(fields) for p, c in zip("tl", f)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Identifier(*shared.value)
        label_memo: dict = {}
        for whole in batches:
            for at in range(0, len(whole), 2000):
                p = whole.iloc[at : at + 2000]
                ids = p["id"].tolist()
                where: dict[str, int] = {}
                jobs = []
                for k in range(len(names)):
                    for ident, text, label in zip(ids, p[f"t{k}"], p[f"l{k}"]):
                        if isinstance(text, str) and text and not text.isspace():
                            jobs.append((k, ident, where.setdefault(text, len(where)), label))
                got = model(list(where))
                rows = []
                for k, ident, j, label in jobs:
                    key = label if isinstance(label, str) else ""
                    if key not in label_memo:
                        label_memo[key] = language_of_label(key)
                    code, found = label_memo[key], got[j]
                    case = bool(found) and (len(found) > 1 or code != found[0][0])
                    if case or not cases_only:
                        rows += [(names[k], ident, seg, lang, conf, n, code, case) for seg, (lang, conf, n) in enumerate(found)]
                out = pd.DataFrame(rows, columns=[f.name for f in _OUT])
                yield out.astype({"id": "int64", "seg": "int32", "n_words": "int32", "confidence": "float64", "is_case": "bool"})

    return picked.mapInPandas(run, _OUT)
