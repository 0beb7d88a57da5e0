"""Problem 3: texts that were copied and slightly changed, found by a prefix-tree join.

1. One pass turns every text into its words; the distinct words, as 64-bit hashes, are the set that is compared.
2. Texts with the same word sequence are one class, represented by its least id; only classes are compared.
3. Words are put into one global order: rare ones first, then the frequent ones by rising frequency.
4. Two sets with similarity t share a word among the first ``n - ceil(t n) + 1`` of each. Each class goes to a bucket for
   each of these words. A frequent word alone makes no bucket: short sets take it together with the next two shared words
   (prefixes longer by one and two), long sets together with their length band.
5. Inside a bucket the ordered sets form a trie. Each set walks it once, sharing the overlap along common prefixes, and
   leaves a subtree as soon as the words left on either side cannot reach the overlap needed.
6. A bucket of more than ``BUCKET_ROWS`` sets forms no trie. Its sets go to narrower buckets, of its words and the next shared
   one; sets so small that they need no further word stay together. What can't be narrowed further is parted by a hash of
   the set, and every two parts meet in a bucket of their own. Rounds go on until no bucket is too large, so no task holds more
   than ``BUCKET_ROWS`` sets of a bucket, whatever words the table's sets share; nothing is capped and no pair is lost.

Overlaps are counted on 64-bit hashes of whole words. What goes to the workers is bounded: the words that rank first by
frequency (``MOST_FREQUENT`` at most) and a bitmap of fixed size that tells words found once (no bucket needed) from the rest;
when it fills up at larger sizes only the pruning gets weaker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import bounded_rows, cut, not_blank, shuffle_width
from parolith.operators.graph import components
from parolith.llm.textforms import is_case, words

FREQUENT = 200
MOST_FREQUENT = 100_000
BITMAP_BITS = 1 << 22
SHORT = 32
#: Sets that may meet in one trie, and parts that a larger bucket is split into when no further word narrows it.
BUCKET_ROWS, PARTS = 2_000, 8
#: Words of a bucket's key up to which further words are added; the second stands for buckets of sets that need no further word.
DEEPEST, WHOLE = 8, 63

_SETS = T.StructType([T.StructField("field", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("words", T.BinaryType())])
#: A set in a bucket, or (rest is null) a pair of sets: bucket and rep.
_POSTS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("field", T.IntegerType()), T.StructField("rep", T.LongType()), T.StructField("how", T.LongType()), T.StructField("rest", T.BinaryType())])


def packed(n: int, last: int, depth: int, side: int) -> int:
    """One number for a set's size, the place in its rest of the last of the bucket's words, their number, and its side (0: meets all)."""
    return ((n << 28 | last) << 6 | depth) << 2 | side


def unpacked(how: int) -> tuple[int, int, int, int]:
    return how >> 36, how >> 8 & (1 << 28) - 1, how >> 2 & 63, how & 3


def word_sets(texts: DataFrame, skip_form_cases: set[int]) -> DataFrame:
    """(field, id, seq, words) of every text with a word; words: the distinct ones as sorted 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[int, str], int] = {}
        for p in batches:
            if len(memo) > 500_000:
                memo.clear()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for field, ident, text in zip(p["field"].tolist(), p["id"].tolist(), p["text"]):
                if field in skip_form_cases and is_case(text):
                    continue
                ws = words(text)
                if not ws:
                    continue
                hashes = set()
                for w in ws:
                    h = memo.get((field, w))
                    if h is None:
                        h = memo[field, w] = field_hash(field, w)
                    hashes.add(h)
                out[0].append(field)
                out[1].append(ident)
                out[2].append(field_hash(field, " ".join(ws)) - (1 << 63))
                out[3].append(np.array(sorted(hashes), dtype="<u8").tobytes())
            yield pd.DataFrame({"field": pd.Series(out[0], dtype="int32"), "id": pd.Series(out[1], dtype="int64"), "seq": pd.Series(out[2], dtype="int64"), "words": pd.Series(out[3], dtype="object")})

    return texts.mapInPandas(run, _SETS)


def field_hash(field: int, text: str) -> int:
    """The field goes into the text and not into the seed: on short texts, seeds and letters can make up for each other."""
    return xxhash.xxh3_64_intdigest(f"{field}\n{text}".encode("utf-8", "surrogatepass"))


def need(n: int, m: int, t: tuple[int, int]) -> int:
    """Least overlap with which sets of n and m words reach the similarity t = (over, under)."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


class SetTrie:
    """Ordered sets below common prefixes; ``partners`` yields those of the stored sets that reach the similarity."""

    __slots__ = ("kids", "ends", "least", "most", "deep")

    def __init__(self) -> None:
        self.kids: dict[int, SetTrie] = {}
        self.ends: list[tuple[int, int]] = []
        self.least, self.most, self.deep = 1 << 60, 0, 0

    def add(self, rep: int, n: int, rest: tuple[int, ...]) -> None:
        node = self
        for k, w in enumerate(rest):
            node.least, node.most, node.deep = min(node.least, n), max(node.most, n), max(node.deep, len(rest) - k)
            node = node.kids.setdefault(w, SetTrie())
        node.least, node.most = min(node.least, n), max(node.most, n)
        node.ends.append((rep, n))

    def partners(self, n: int, rest: tuple[int, ...], t: tuple[int, int]) -> list[int]:
        place = {w: k for k, w in enumerate(rest)}
        found, stack = [], [(self, 0, 0)]
        while stack:
            node, at, shared = stack.pop()
            found += [rep for rep, m in node.ends if shared >= need(n, m, t)]
            for w, kid in node.kids.items():
                k = place.get(w, -1)
                now, left = (shared + 1, k + 1) if k >= at else (shared, at)
                if now + min(len(rest) - left, kid.deep) >= need(n, kid.least, t) and kid.least * t[0] <= n * t[1] and n * t[0] <= kid.most * t[1]:
                    stack.append((kid, left, now))
        return found


def bucket_keys(ordered: list[int], frequent: dict[int, int], once: np.ndarray | None, t: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(bucket, place of its first word, place of its last word, words) of an ordered set.

    A partner shares at least ``q = ceil(t n)`` words with a set of n. Two sets whose larger q is 1, 2, or 3 and more meet in a
    bucket of that many shared words if the first of these is frequent: the first c shared words lie within the first
    ``n - max(q, c) + 1``, one more, and one more again. Where it is rare, it makes the bucket alone.
    """
    n = len(ordered)
    q = -(-t[0] * n // t[1])
    keys = []
    for i in range(n - q + 1):
        w = ordered[i]
        if w not in frequent:
            if once is None or once[(w & (BITMAP_BITS - 1)) >> 6] >> np.uint64(w & 63) & np.uint64(1):
                keys.append((w, i, i, 1))
            continue
        if n <= SHORT:
            for c in range(min(q, 3), min(3, n) + 1):
                first = n - max(q, c) + 1
                if i >= first:
                    continue
                if c == 1:
                    keys.append((hash_all([w]), i, i, WHOLE))
                elif c == 2:
                    keys += [(hash_all([w, ordered[j]]), i, j, WHOLE) for j in range(i + 1, first + 1)]
                else:
                    keys += [(hash_all([w, ordered[j], ordered[k]]), i, k, 3) for j, k in combinations(range(i + 1, min(n, first + 2)), 2) if j <= first]
        if n >= SHORT * t[0] // t[1]:
            band = int(np.floor(np.log(n) / np.log(t[1] / t[0]) + 1e-9))
            keys += [(hash_all([w, 0, 0, band]), i, i, 1), (hash_all([w, 0, 0, band + 1]), i, i, 1)]
    return keys


def narrower(bucket: int, rep: int, how: int, rest: Sequence[int], t: tuple[int, int]) -> list[tuple[int, int]]:
    """(bucket, how) of the buckets in which a set of too large a bucket meets the same sets.

    Two sets that share more words than the bucket's c meet where the next shared word is added; it lies within the first
    ``n - max(q, c + 1) + c + 1`` words. Two that need no more than c words both stay.
    """
    n, last, depth, side = unpacked(how)
    mine = bucket & (1 << 64) - 1
    if depth < DEEPEST:
        q = -(-t[0] * n // t[1])
        made = [(hash_all([mine, 1]), packed(n, last, WHOLE, 0))] if q <= depth else []
        end = n - max(q, depth + 1) + depth - (n - len(rest))
        return made + [(hash_all([mine, 2, rest[j]]), packed(n, j, depth + 1, 0)) for j in range(last + 1, min(end, len(rest) - 1) + 1)]
    own = hash_all([mine, 3, rep & (1 << 64) - 1]) % PARTS
    made = []
    for other in range(PARTS):
        if side == 0:
            a, b, s = min(own, other), max(own, other), 0 if own == other else 1 if own < other else 2
        else:
            a, b, s = (own, other, 1) if side == 1 else (other, own, 2)
        made.append((hash_all([mine, 4, a, b]), packed(n, last, WHOLE, s)))
    return made


def hash_all(values: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(values, dtype="<u8").tobytes())


class _Rows:
    """Rows of _POSTS under way to a frame."""

    def __init__(self) -> None:
        self.columns: tuple[list, list, list, list, list] = ([], [], [], [], [])

    def add(self, bucket: int, field: int, rep: int, how: int, rest: bytes | None) -> None:
        a, b, c, d, e = self.columns
        a.append(bucket)
        b.append(field)
        c.append(rep)
        d.append(how)
        e.append(rest)

    def frame(self) -> pd.DataFrame:
        made = pd.DataFrame({f.name: pd.Series(c, dtype="object" if f.name == "rest" else "int32" if f.name == "field" else "int64") for f, c in zip(_POSTS, self.columns)})
        self.__init__()
        return made


def _postings(classes: DataFrame, frequent: dict[int, int], bitmap: np.ndarray, t: tuple[int, int]) -> DataFrame:
    sc = classes.sparkSession.sparkContext
    shared = sc.broadcast((frequent, bitmap))  # MOST_FREQUENT words and BITMAP_BITS bits at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, once = shared.value
        out = _Rows()
        for p in batches:
            for field, rep, raw in zip(p["field"].tolist(), p["rep"].tolist(), p["words"]):
                ordered = np.frombuffer(raw, dtype="<u8").tolist()
                ordered.sort(key=lambda w: (often.get(w, 0), w))
                keys = bucket_keys(ordered, often, once, t)
                if keys:
                    whole = np.array(ordered, dtype="<u8").tobytes()
                    size = packed(len(ordered), 0, 0, 0)
                    for key, i, j, depth in keys:
                        out.add(key - (1 << 63), field, rep, size | j - i << 8 | depth << 2, whole[8 * i :])
            yield out.frame()

    return classes.mapInPandas(run, _POSTS)


def _solve_buckets(posts: DataFrame, t: tuple[int, int], most: int) -> DataFrame:
    """Pairs of the buckets of at most that many sets, and the sets of the others in narrower ones; a bucket is a run of sorted rows."""

    def solve(rows: list[tuple[int, int, int, bytes]], out: _Rows) -> None:
        trie, seen, found = SetTrie(), set(), set()
        rows.sort(key=lambda r: r[2] & 3)  # the left side first
        for field, rep, how, raw in rows:
            if (rep, len(raw), how & 3) in seen:
                continue
            seen.add((rep, len(raw), how & 3))
            rest = tuple(np.frombuffer(raw, dtype="<u8").tolist())
            n, side = how >> 36, how & 3
            if side != 1:
                found |= {(field, min(rep, o), max(rep, o)) for o in trie.partners(n, rest, t) if o != rep}
            if side != 2:
                trie.add(rep, n, rest)
        for field, a, b in found:
            out.add(a, field, b, 0, None)

    def part(bucket: tuple[int, int], rows: list[tuple[int, int, int, bytes]], out: _Rows) -> None:
        for field, rep, how, raw in rows:
            for key, now in narrower(bucket[0], rep, how, np.frombuffer(raw, dtype="<u8").tolist(), t):
                out.add(key - (1 << 63), field, rep, now, raw)

    def end(bucket: tuple[int, int], rows: list[tuple[int, int, int, bytes]], large: bool, out: _Rows) -> None:
        if large:
            part(bucket, rows, out)
        elif len(rows) > 1:
            solve(rows, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, large, out = (0, 0), [], False, _Rows()
        for p in batches:
            for bucket, field, rep, how, rest in zip(p["bucket"].tolist(), p["field"].tolist(), p["rep"].tolist(), p["how"].tolist(), p["rest"]):
                if (bucket, field) != now:
                    end(now, rows, large, out)
                    now, rows, large = (bucket, field), [], False
                rows.append((field, rep, how, rest))
                if len(rows) > most:
                    large = True
                    part(now, rows, out)
                    rows = []
            yield out.frame()
        end(now, rows, large, out)
        yield out.frame()

    width = max(shuffle_width(posts.sparkSession), 2)
    return posts.repartition(width, "bucket").sortWithinPartitions("bucket", "field").mapInPandas(run, _POSTS)


def _join_buckets(posts: DataFrame, t: tuple[int, int], most: int = BUCKET_ROWS) -> DataFrame:
    """(field, a, b): pairs of representatives of one field; a round for every depth that some bucket needs."""
    pairs: list[DataFrame] = []
    while True:
        done = cut(_solve_buckets(posts, t, most))
        pairs.append(done.where("rest is null").select("field", F.col("bucket").alias("a"), F.col("rep").alias("b")))
        posts = done.where("rest is not null")
        if posts.isEmpty():
            return reduce(DataFrame.union, pairs).distinct()


def near_copies(texts: DataFrame, t: tuple[int, int] = (4, 5), skip_form_cases: set[int] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(links, members) of texts (field int, id long, text string); t is the least similarity as a fraction.

    links: (field, a, b), the least ids of two classes whose sets of distinct words reach the similarity and whose
    word sequences differ. members: (field, rep, id) of every class with several texts, its least id among them.
    Null, blank and wordless texts take no part; a text is compared with those of its own field alone.
    """
    texts = texts.where(not_blank("text") & F.col("id").isNotNull() & F.col("field").isNotNull()).select(F.col("field").cast("int").alias("field"), F.col("id").cast("long").alias("id"), "text")
    sets = cut(word_sets(texts, set(skip_form_cases)))
    return link_sets(sets, t)


def link_sets(sets: DataFrame, t: tuple[int, int], most: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, members) of sets (field, id, seq, words), as ``near_copies`` gives them."""
    classes = sets.groupBy("field", "seq").agg(F.min(F.struct("id", "words")).alias("x"), F.count("*").alias("n"))
    classes = cut(classes.select("field", "seq", F.col("x.id").alias("rep"), "n", "x.words"))
    counts = _exploded(classes).groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    total = classes.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    least = max(FREQUENT, int(total) // MOST_FREQUENT)
    slot = F.shiftrightunsigned(F.col("w").bitwiseAND(BITMAP_BITS - 1), 6)
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    told = counts.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"), F.collect_list(F.when(F.col("c") >= least, F.struct("w", "c"))).alias("often")).toPandas()
    bitmap = np.zeros(BITMAP_BITS // 64, dtype="<u8")
    bitmap[told["slot"].to_numpy(dtype="int64")] = told["bits"].to_numpy(dtype="int64").astype("u8")
    frequent = {int(x["w"]) & (1 << 64) - 1: int(x["c"]) for often in told["often"] for x in often}
    links = _join_buckets(_postings(classes.select("field", "rep", "words"), frequent, bitmap, t), t, most)
    several = classes.where("n > 1").select("field", "seq", "rep")
    return links, sets.select("field", "seq", "id").join(several, ["field", "seq"]).select("field", "rep", "id")


def _exploded(classes: DataFrame) -> DataFrame:
    """One row per class and word hash, as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"w": np.frombuffer(b"".join(p["words"]), dtype="<i8")})

    return classes.select("words").mapInPandas(run, "w long")


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(field, id_a, id_b): every pair of texts behind every link."""
    ma = members.select("field", F.col("rep").alias("a"), F.col("id").alias("ia"))
    mb = members.select("field", F.col("rep").alias("b"), F.col("id").alias("ib"))
    pairs = links.join(ma, ["field", "a"], "left").join(mb, ["field", "b"], "left")
    x, y = F.coalesce("ia", "a"), F.coalesce("ib", "b")
    return pairs.select("field", F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))


def near_groups(links: DataFrame, members: DataFrame, most_fields: int = 64) -> DataFrame:
    """(field, id, group_id, n_links): every text with a near copy, its group's least id, and the classes it is linked to."""
    links = cut(links)
    ends = links.select("field", F.col("a").alias("rep")).union(links.select("field", F.col("b").alias("rep")))
    degree = ends.groupBy("field", "rep").agg(F.count("*").alias("n_links"))
    made = degree.select("field", "rep", F.col("rep").alias("group_id")).limit(0)
    for (field,) in bounded_rows(links.select("field").distinct(), most_fields, "the list of fields"):
        mine = components(links.where(F.col("field") == field))
        made = made.union(mine.select(F.lit(field).alias("field"), F.col("node").alias("rep"), F.col("component").alias("group_id")))
    whole = made.join(degree, ["field", "rep"]).join(members, ["field", "rep"], "left")
    return whole.select("field", F.coalesce("id", "rep").alias("id"), "group_id", "n_links")
