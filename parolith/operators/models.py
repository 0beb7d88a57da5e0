"""Language models as plug-ins: any callable from a prompt to a text. Nothing is downloaded; without a model the rules decide."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from parolith.functions import text as X
from parolith.operators.interpret import first_lines
from parolith.sources.files import write_text

Model = Callable[[str], str]

QUESTION = "Is the following line a proverb (short advice or an aphorism) or not (a citation, a licence, navigation)? Answer PROVERB or NOT_PROVERB.\nLine: {line}\nAnswer:"
TASK = (
    "Below are claims found across cultures, each with its coverage (peoples), support (instances) and the most frequent metadata of its peoples.\n"
    "1. Name five to eight themes that hold the claims of the widest coverage.\n2. For each, choose one or two claims and reason from the evidence given alone.\n"
    "3. Offer three to five hypotheses on themes and context that can be tested.\n4. Point out contradictions, and contexts in which either side holds.\n\n{summary}"
)


def is_yes(answer: str) -> bool:
    """Whether an answer says that a line is a proverb; an answer that denies it holds the word too."""
    word = answer.strip().upper()
    return "PROVERB" in word and not word.startswith("NOT")


def find_model(folder: str = "models") -> Model | None:
    """The first model file (.gguf, by name) of a local folder, loaded if the runtime for it is installed; else None."""
    found = sorted(Path(folder).glob("*.gguf")) if Path(folder).is_dir() else []
    if not found:
        return None
    try:
        from llama_cpp import Llama
    except ImportError:
        return None
    loaded = Llama(model_path=str(found[0]), n_ctx=4096, n_threads=4, verbose=False)
    return lambda prompt: loaded.create_completion(prompt, max_tokens=900, temperature=0.0)["choices"][0]["text"]


def classifier(model: Model) -> Callable[[Column], Column]:
    """A row filter's verdict by a model, in Arrow batches, for ``filter_cascade``; null where the model fails, so that the rules decide."""

    @F.pandas_udf("boolean")
    def ask(lines: pd.Series) -> pd.Series:
        memo: dict[str, bool | None] = {}

        def one(line: str | None) -> bool | None:
            if not isinstance(line, str):
                return None
            if line not in memo:
                try:
                    memo[line] = is_yes(model(QUESTION.format(line=line)))
                except Exception:  # noqa: BLE001
                    memo[line] = None
            return memo[line]

        return lines.map(one).astype("boolean")

    return lambda c: F.coalesce(ask(c), ~X.filter_bibliography(c) & X.filter_cues(c))


def narrative(summary: str, model: Model | None = None) -> str:
    """A model's narrative of the first 400 lines of a report; without a model, or if it fails, a note in its place."""
    if model is None:
        return "No narrative: no model was given."
    try:
        return str(model(TASK.format(summary=first_lines(summary))))
    except Exception as e:  # noqa: BLE001
        return f"No narrative: the model failed ({type(e).__name__})."


def write_narrative(spark: SparkSession, summary: str, path: str, model: Model | None = None) -> str:
    """Writes the narrative, or the note in its place, and gives the path."""
    write_text(spark, narrative(summary, model), path)
    return path
