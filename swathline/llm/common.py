"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import stored as written

__all__ = ["CHARS_AT_ONCE", "held", "portions", "release", "stretches", "table", "texts_of", "written"]

#: Characters of text that one NumPy pass takes at once, so that a batch of long documents stays small in memory.
CHARS_AT_ONCE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(texts: list, most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``most`` characters each; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_SEAM = re.compile(r"(?<=\w) (?=\w)")


def stretches(text: str, most: int = CHARS_AT_ONCE) -> Iterator[str]:
    """The text in stretches of about ``most`` characters, cut only before a single space between two word characters.

    Word splits of byte-level and piece vocabularies have a border there in any
    case, so stretches are encoded each on its own. Without such a space there is
    no cut.
    """
    at = 0
    while len(text) - at > most:
        seam = _SEAM.search(text, at + most)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def texts_of(column: pd.Series, null: str = "") -> list[str]:
    """Python strings, with ``null`` in place of nulls."""
    return [t if isinstance(t, str) else null for t in column]


_HELD: dict[str, Any] = {}


def held(token: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in each Python worker: the tasks of one job share it. Only the latest is held."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = make()
    return _HELD[token]


def release() -> None:
    """Drops what an earlier job's tasks hold in this worker; for tasks that hold nothing themselves and need the room."""
    import pyarrow as pa

    _HELD.clear()
    pa.default_memory_pool().release_unused()
