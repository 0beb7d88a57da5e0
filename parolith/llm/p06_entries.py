"""Problem 6: freely typed values mapped to a reference list.

The reference entries form a trie, each under several alias paths (those given, in the plural, with its words turned round,
with the first word cut short); a value enters it as it is, and without an article or a generic noun. A Levenshtein automaton
(with transpositions) walks the trie: one row of edit distances per node, a subtree is left as soon as its row exceeds the
entry's allowance, which depends on the entry's length. All entries within reach come back (``near_entries``);
``map_entries`` takes the nearest. Of entries equally near, the one that shares more of the value's beginning and end is taken,
then the first in order.

The list must be small (``max_entries``, refused beyond) and goes to the workers once; values are matched in one narrow
pass with a bounded memo per worker, so a value that holds a third of all rows costs one search per worker and no shuffle.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import bounded_rows, not_blank, quoted, with_id

ARTICLES = ("the",)
NOUNS = ("people", "peoples", "proverbs", "proverb", "sayings", "folk sayings", "folk", "culture", "nation")
MEMO = 200_000


def plain(value: str) -> str:
    """Lower case, without accents; whatever is neither letter nor digit is one blank."""
    bare = "".join(c for c in ud.normalize("NFKD", value.casefold()) if not ud.combining(c))
    return re.sub(r"[\W_]+", " ", bare).strip()


def allowance(length: int) -> int:
    """Edits allowed for an entry of that many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


class EntryTrie:
    """Reference entries under their alias paths; ``search`` gives {entry: distance} for all entries within reach."""

    def __init__(self, entries: Sequence[str], articles: Sequence[str] = ARTICLES, nouns: Sequence[str] = NOUNS, aliases: Mapping[str, Sequence[str]] | None = None):
        self.exact = set(entries)
        self.root: dict = {}
        for entry in sorted(self.exact):
            base = plain(entry)
            if not base:
                continue
            first, _, rest = base.partition(" ")
            forms = {base, f"{base}s"} | ({f"{rest} {first}", f"{first[:2]} {rest}", f"{first[:3]} {rest}"} if rest else set())
            given = {plain(a) for a in (aliases or {}).get(entry, ())} - forms - {""}
            for path in sorted(forms | given):
                node = self.root
                for ch in path:
                    node = node.setdefault(ch, {})
                node.setdefault("", []).append((entry, allowance(len(path if path in given else base))))
        self.leading = tuple(f"{a} " for a in articles)
        self.trailing = tuple(sorted((f" {n}" for n in nouns), key=len, reverse=True))
        self._reach(self.root)

    def _reach(self, node: dict) -> int:
        """Stores at every node the largest allowance below it."""
        most = max([0, *(k for _, k in node.get("", ()))])
        for ch, child in list(node.items()):
            if len(ch) == 1:
                most = max(most, self._reach(child))
        node["most"] = most
        return most

    def paths(self, value: str) -> list[str]:
        """The alias paths a value may enter by: as it is, and without an article or a generic noun."""
        word = plain(value)
        forms = [word]
        for a in self.leading:
            forms += [f[len(a) :] for f in forms if f.startswith(a)]
        for n in self.trailing:
            forms += [f[: -len(n)] for f in forms if f.endswith(n)]
        return [f for f in dict.fromkeys(forms) if f]

    def search(self, value: str) -> dict[str, int]:
        """All entries within reach of any of the value's paths, with their least distance."""
        found: dict[str, int] = {}
        for word in self.paths(value):
            for entry, d in self._walk(word).items():
                found[entry] = min(d, found.get(entry, d))
        return found

    def _walk(self, word: str) -> dict[str, int]:
        found: dict[str, int] = {}
        n = len(word)
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            for entry, most in node.get("", ()):
                if row[n] <= most and row[n] < found.get(entry, 99):
                    found[entry] = row[n]
            for ch, child in node.items():
                if len(ch) != 1:
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != ch))
                    if before and i > 1 and word[i - 1] == last and word[i - 2] == ch:
                        d = min(d, before[i - 2] + 1)
                    new.append(d)
                if min(new) <= child["most"] or min(row) < child["most"]:
                    stack.append((child, ch, new, row))
        return found

    def best(self, value: str) -> tuple[str, int]:
        """The nearest entry and its distance, the first in order among equals; ("", -1) if none is within reach."""
        if value in self.exact:
            return value, 0
        for word in self.paths(value):
            node = self.root
            for ch in word:
                node = node.get(ch) if len(ch) == 1 else None
                if node is None:
                    break
            if node and "" in node:
                return min(e for e, _ in node[""]), 0
        return next(iter(self.ranked(value)), ("", -1))

    def ranked(self, value: str) -> list[tuple[str, int]]:
        """All entries within reach and their distances, the nearest first."""
        word = plain(value)
        return sorted(self.search(value).items(), key=lambda x: (x[1], -common_ends(word, plain(x[0])), x[0]))


def common_ends(a: str, b: str) -> int:
    """How many characters two words share at their beginning and at their end together."""
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((k for k, (x, y) in enumerate(zip(a[:head - 1 - len(a):-1], b[:head - 1 - len(b):-1])) if x != y), min(len(a), len(b)) - head)
    return head + tail


def _matched(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, entry_col: str, max_entries: int, keep_exact: bool, all_near: bool, options: dict) -> DataFrame:
    entries = [r[0] for r in bounded_rows(reference.select(quoted(entry_col).cast("string")).where(not_blank(quoted(entry_col))).distinct(), max_entries, "the reference list")]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((entries, options))  # bounded by max_entries
    rows = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(value_col).cast("string").alias("value")).where(not_blank("value"))
    if not keep_exact and entries:
        listed = spark.createDataFrame([(e,) for e in entries], "value string")
        rows = rows.join(F.broadcast(listed), "value", "left_anti").select("id", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = EntryTrie(shared.value[0], **shared.value[1])
        memo: dict[str, list[tuple[str, int]]] = {}
        for b in batches:
            if len(memo) > MEMO:
                memo.clear()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for ident, v in zip(b["id"].tolist(), b["value"]):
                got = memo.get(v)
                if got is None:
                    got = memo[v] = (trie.ranked(v) or [("", -1)]) if all_near else [trie.best(v)]
                for entry, distance in got:
                    for column, x in zip(out, (ident, v, entry, distance)):
                        column.append(x)
            yield pd.DataFrame({"id": pd.Series(out[0], dtype="int64"), "value": pd.Series(out[1], dtype="object"), "entry": pd.Series(out[2], dtype="object"), "distance": pd.Series(out[3], dtype="int32")})

    return rows.mapInPandas(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("distance", T.IntegerType())]))


def map_entries(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, entry_col: str, max_entries: int = 100_000, keep_exact: bool = True, articles: Sequence[str] = ARTICLES, nouns: Sequence[str] = NOUNS, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id, value, entry, distance) of every row whose value is neither null nor blank.

    entry is the nearest entry of the reference list, or the empty string (distance -1) for an unmatched value.
    keep_exact=False leaves out values that are an entry as they stand. Nulls and blanks of the reference list are no
    entries, repeated ones count once; an empty list leaves every value unmatched. Values of any length are read whole.
    articles and nouns are what a value may carry besides the entry (plain lower-case words); aliases gives other names of entries.
    """
    return _matched(df, id_col, value_col, reference, entry_col, max_entries, keep_exact, False, {"articles": tuple(articles), "nouns": tuple(nouns), "aliases": dict(aliases or {})})


def near_entries(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, entry_col: str, max_entries: int = 100_000, articles: Sequence[str] = ARTICLES, nouns: Sequence[str] = NOUNS, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id, value, entry, distance) with a row for every entry within the reach of a value; the empty entry (distance -1) where there is none.

    Rows and options are those of ``map_entries``.
    """
    return _matched(df, id_col, value_col, reference, entry_col, max_entries, True, True, {"articles": tuple(articles), "nouns": tuple(nouns), "aliases": dict(aliases or {})})
