"""Embedding through any callable from texts to vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embed(
    text: Column, client: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = 16, longest: int | None = None, retries: int = 2, pause: float = 2.0, lost: str = "raise"
) -> Column:
    """Vectors of texts, in batches.

    A batch that fails, or gives another number of vectors, is tried again after ``pause`` seconds,
    then twice that, and so on; one that keeps failing gives nulls.  A lost connection ends the task
    (``lost="raise"``) or gives nulls from there on (``"null"``), so that what was embedded is kept.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = True
        for texts in batches:
            values = [(t or "")[:longest] for t in texts]
            vectors: list = []
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                found: list | None = None
                for attempt in range(retries + 1 if here else 0):
                    try:
                        found = [list(v) for v in client(part)]
                        if len(found) != len(part):
                            raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                        break
                    except ConnectionError:
                        if lost == "raise":
                            raise
                        found, here = None, False
                        break
                    except Exception:
                        found = None
                        if attempt < retries:
                            time.sleep(pause * (attempt + 1))
                vectors += found or [None] * len(part)
            yield pd.Series(vectors, dtype=object)

    return run(text)
