"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter and never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parolith.llm.common import quoted, with_id

DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"
_LOADED: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(id, n_tokens, *keep): the tokens of every whole text; a null or empty one has none."""
    path = path or default_path()
    picked = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"), *[quoted(k) for k in keep])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_tokens", T.LongType()), *[picked.schema[k] for k in keep]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for p in batches:
            sizes = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in p["text"]]
            yield pd.DataFrame({"id": p["id"], "n_tokens": pd.Series(sizes, dtype="int64", index=p.index), **{k: p[k] for k in keep}})

    return picked.mapInPandas(run, schema)
