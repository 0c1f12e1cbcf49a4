"""What several corpus operators share: words, batches, and the shared work folder."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.sources.work import stored, work_path

__all__ = ["stored", "work_path"]  # imported from here by the operators

#: Fixed value: a word is a run of anything but space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^ \t-\r]+")

#: Texts are handled in pieces of about this many bytes, so that numpy's scratch arrays stay small.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings of the session while the block runs."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pieces(texts: Sequence, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) slices of about ``limit`` characters, whole texts only."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return freed memory to the machine: Python workers live on between tasks and stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few of their rows are Python objects at a time; what is freed goes back at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


class Words:
    """The words of some texts: ``codes`` into ``unique``, those of text i at ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, texts: Sequence[bytes]):
        found: list[bytes] = []
        ends = [0]
        for t in texts:
            found += WORD_BYTES.findall(t)
            ends.append(len(found))
        flat = np.empty(len(found), dtype=object)
        flat[:] = found
        self.codes, self.unique = pd.factorize(flat) if len(found) else (np.zeros(0, np.int64), flat)
        self.bounds = np.array(ends, dtype=np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each unique word, the same in every process."""
        if not len(self.unique):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(self.unique, categorize=False)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, 0 where that is empty; each from its own values alone."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=kind)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=kind)
    return out


def ends(sizes) -> np.ndarray:
    """The bounds of consecutive slices of these sizes."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SPACE = byte_table(b" \t\n\v\f\r")
IS_CONTINUATION = byte_table(bytes(range(0x80, 0xC0)))
