"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file set is a Parquet table of blocks that Spark writes and commits, so that a lost executor's
block is written anew and any shared storage serves. Documents lie in ascending doc_id order (null
first, ties by a hash of their text). A block holds whole documents, about ``BLOCK_IDS`` ids or
one longer document:

    part, block        place of the block in the whole order
    start              ids before the block within its part
    doc_ids, sizes     its documents and how many ids each has
    table              little-endian 32-bit ids by rank, the block's commonest first
    control, data      ranks in groups of four: a control byte with four 2-bit lengths less one, and
                       apart from it each rank's 1 to 4 bytes, least significant first

Each document ends with an end id. Null and empty texts have that id alone. Empty tables give an
empty file set; repeated rows are stored each; a very long text is a block of its own; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Cutter, TextEncoder, by_words, byte_symbols
from .common import ends, pieces, slices, text_or_empty

BLOCK_IDS = 1 << 18
END_ID = 2
#: This encoder runs in jobs of its own and has room for more.
REMEMBERED = 700_000

BLOCKS = "part int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, table binary, control binary, data binary"

#: By control byte: the lengths of its four numbers.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``table, control, data`` of an array of ids."""
    count = np.bincount(ids)
    known = np.flatnonzero(count)
    order = np.lexsort((known, -count[known]))
    rank = np.zeros(len(count), dtype=np.int64)
    rank[known[order]] = np.arange(len(known))
    ranks = rank[ids]
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = wide[np.arange(4) < size[:, None]]
    return known[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again: lengths by table lookup, places by their running sum."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    ranks = raw[at]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        ranks[more] |= raw[at[more] + k] << (8 * k)
    return np.frombuffer(table, dtype="<u4")[ranks]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> TextEncoder:
    """Texts through the ``tokenizers`` library: its normaliser and pattern where they matter, its model for each distinct word."""
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    # The model takes words as the file's byte-level step leaves them: a character for each byte.
    symbols = dict(enumerate(byte_symbols()))

    def encode(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        # Printable ASCII stands for itself.
        found = [[t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(symbols))] for w in words]
        bounds = ends([len(x) for x in found])
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(bounds[-1])), bounds

    with open(path, encoding="utf-8") as f:
        return TextEncoder(Cutter(path, json.load(f)), by_words(encode), remembered=REMEMBERED)


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write the file set at ``path``; Spark deals the documents out by ranges of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(vocabulary), TaskContext.get().partitionId()
        block = start = held = 0
        doc_ids, sizes, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            flat = np.concatenate(ids)
            row = [part, block, start, len(flat), [*doc_ids], [*sizes], *pack(flat)]
            block, start, held = block + 1, start + len(flat), 0
            for x in (doc_ids, sizes, ids):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split(" ")[0] for c in BLOCKS.split(", ")])

        for batch in slices(batches):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces(texts):
                flat, bounds = encoder.encode(texts[a:b])
                for i in range(b - a):
                    own = np.append(flat[bounds[i] : bounds[i + 1]], end_id)
                    doc_ids.append(names[a + i])
                    sizes.append(len(own))
                    ids.append(own)
                    held += len(own)
                    if held >= block_ids:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit, binary) of each stored document."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # A row for each part, of which there are as many as tasks wrote: their starts in the whole order.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["table"], r["control"], r["data"], r["n_ids"])
                bounds = ends(r["sizes"])
                own = [ids[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                starts = bounds[:-1] + r["part_start"] + r["start"]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksums(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
