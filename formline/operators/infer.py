"""A model call as a function between prompts and decisions: cached by prompt, repaired once, retried within bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ANSWERS = "digest string, answer string, valid boolean, repairs int, attempts int, error string"


class Unavailable(Exception):
    """The model did not answer; another try may."""


def ask(prompt: str, model: Callable[[str], str], valid: Callable[[str], bool], tries: int = 3, repair: Callable[[str, str], str] | None = None) -> tuple[str | None, bool, int, int, str | None]:
    """(answer, valid, repairs, attempts, error): tries within bounds, and one more question about an answer that is none."""
    attempts, repairs, answer, error = 0, 0, None, None
    question = prompt
    while attempts < tries:
        attempts += 1
        try:
            answer, error = model(question), None
        except Unavailable as e:
            error = str(e) or "unavailable"
            continue
        if valid(answer):
            return answer, True, repairs, attempts, None
        if repairs or repair is None:
            break
        repairs, question = 1, repair(prompt, answer)
    return answer, False, repairs, attempts, error


def infer(prompts: DataFrame, model: Callable[[str], str], valid: Callable[[str], bool], tries: int = 3, repair: Callable[[str, str], str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Answers to the distinct prompts (digest, prompt) that ``known``, answers of before, does not hold; only valid ones are worth keeping there."""
    open_ = prompts.select("digest", "prompt").dropDuplicates(["digest"])
    if known is not None:
        open_ = open_.join(known.where("valid").select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *ask(p, model, valid, tries, repair)) for d, p in zip(pdf["digest"], pdf["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["digest", "answer", "valid", "repairs", "attempts", "error"])

    return open_.mapInPandas(run, ANSWERS)
