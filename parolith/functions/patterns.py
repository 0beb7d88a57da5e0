"""Regular expressions that read the same text alike in Spark (Java) and in the SQL the queries are checked with (RE2).

Letters, digits and the underscore are word characters in every script, and white space is white space in every script, so
no pattern depends on a dialect's idea of ``\\w``, ``\\b`` or ``\\s``.
"""

from __future__ import annotations

from collections.abc import Iterable

W = r"\p{L}\p{N}_"
S = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
ENDS = ".!?;:"


def whole_words(words: Iterable[str]) -> str:
    """A case-insensitive search for any of the words (patterns themselves), standing alone.

    Without lookaround, for both dialects: good for searching, not for replacing.
    """
    return rf"(?i)(?:^|[^{W}])(?:{'|'.join(words)})(?:$|[^{W}])"


def strip(column: str) -> str:
    """SQL text, in both dialects but for the flag: white space of any kind off both ends."""
    return f"regexp_replace({column}, '^[{S}]+|[{S}]+$', ''"
