"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed, weighing the root of their counts at unit length;
structure statistics in logarithmic steps; and the size that the table states for it (``n_chars``,
where there is such a column). All features interact pairwise through vectors of rank ``RANK``; by
the sum-of-squares identity, sum over i < j of <vi, vj> xi xj is half of (sum vi xi)^2 - sum (vi xi)^2
for each factor, so scoring is linear in the number of features.

Labels, lang, source and doc_id are never features. Fitted on a bounded sample of labelled rows
outside the held-out fold. Null texts count as empty and are scored by their structure; without
labelled rows each score is 0.5. Very long texts are scored whole. Repeated rows get the same score;
empty tables give empty results; other columns are ignored, or kept by :func:`with_score`, which
refuses a name for the score that a column of the table has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_CONTINUATION, Words, byte_table, ends, give_back, mix64, pieces, sums, text_or_empty
from .labelled import SAMPLE_ROWS, labelled_sample

RANK, BITS = 8, 16
STEPS = 12
CLASSES = {
    "symbols": byte_table(b"#*$%&|<>"),
    "marks": byte_table(b"!?.,;:"),
    "shouts": byte_table(b"!"),
    "upper": byte_table(bytes(range(65, 91))),
    "digits": byte_table(bytes(range(48, 58))),
    "lines": byte_table(b"\n"),
    "beyond_ascii": byte_table(bytes(range(0xC0, 0x100))),
}
STATISTICS = [*CLASSES, "words", "word_length", "distinct_words", "distinct_lines", "commonest", "stated_size"]


def _step(x: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] to 0..STEPS - 1, finer near 0."""
    return np.clip(np.ceil(np.log2(np.maximum(x, 1e-9) * 2048)), 0, STEPS - 1).astype(np.int64)


def features(texts: Sequence[bytes], stated: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values, flat, and where each text's begin and end."""
    n = len(texts)
    words = Words(texts)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = ends([len(t) for t in texts])
    chars = np.maximum(sums((~IS_CONTINUATION[flat]).view(np.uint8), bounds), 1)
    # Distinct words of each text and their counts.
    width = max(len(words.unique), 1)
    pair, count = np.unique(words.owners() * width + words.codes, return_counts=True)
    owner, code = pair // width, pair % width
    kinds = np.bincount(owner, minlength=n)
    per_doc = ends(kinds)
    total = np.maximum(words.counts, 1)
    values = np.sqrt(count / total[owner])
    index = (mix64(words.hashes()) >> np.uint64(64 - BITS)).astype(np.int64)[code] if len(code) else code.astype(np.int64)
    most = np.zeros(n)
    most[kinds > 0] = np.maximum.reduceat(count, per_doc[:-1][kinds > 0]) if len(count) else 0
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    shares = [sums(t[flat].view(np.uint8), bounds) / chars for t in CLASSES.values()]
    steps = [_step(s) for s in shares]
    steps.append(np.clip(np.log2(words.counts + 1), 0, STEPS - 1).astype(np.int64))
    steps.append(np.clip(chars / total, 0, STEPS - 1).astype(np.int64))
    steps.append(np.floor(kinds / total * (STEPS - 1)).astype(np.int64))
    steps.append(np.array([len(set(x)) * (STEPS - 1) // max(len(x), 1) for x in lines], dtype=np.int64))
    steps.append(_step(most / total))
    size = np.array([-1 if s is None or s != s else max(s, 0) for s in stated], dtype=float)
    steps.append(np.where(size < 0, STEPS - 1, np.clip(np.log2(np.maximum(size, 0) + 1) / 2, 0, STEPS - 2)).astype(np.int64))
    fixed = np.stack(steps, axis=1) + (1 << BITS) + STEPS * np.arange(len(STATISTICS))
    # Each text's words, then its statistics.
    order = np.argsort(np.concatenate([owner, np.repeat(np.arange(n), len(STATISTICS))]), kind="stable")
    index = np.concatenate([index, fixed.reshape(-1)])[order]
    values = np.concatenate([values, np.full(n * len(STATISTICS), 0.5)])[order]
    return index, values, ends(kinds + len(STATISTICS))


class FactorisationMachine:
    def __init__(self, seed: int = 10) -> None:
        size = (1 << BITS) + STEPS * len(STATISTICS)
        self.bias = 0.0
        self.linear = np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (size, RANK))

    def margin(self, index: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        vx = self.factors[index] * values[:, None]
        pairs = (sums(vx, bounds) ** 2 - sums(vx * vx, bounds)).sum(axis=1) / 2
        return self.bias + sums(self.linear[index] * values, bounds) + pairs

    def score(self, texts: Sequence[bytes], stated: Sequence) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*features(texts, stated)), -40, 40)))

    def fit(self, index: np.ndarray, values: np.ndarray, bounds: np.ndarray, labels: np.ndarray, *, passes: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 10) -> FactorisationMachine:
        """AdaGrad on the logistic loss over texts' features, in mini-batches dealt by a fixed seed."""
        n = len(labels)
        if not n:
            self.factors *= 0
            return self
        deal, y = np.random.default_rng(seed), labels.astype(float)
        seen = [1e-6, np.full(self.linear.shape, 1e-6), np.full(self.factors.shape, 1e-6)]
        for _ in range(passes):
            order = deal.permutation(n)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = bounds[rows + 1] - bounds[rows]
                b = ends(sizes)
                where = np.repeat(bounds[rows] - b[:-1], sizes) + np.arange(b[-1])
                i, x = index[where], values[where]
                wrong = (1 / (1 + np.exp(-np.clip(self.margin(i, x, b), -40, 40))) - y[rows]) / len(rows)
                each = np.repeat(wrong, sizes) * x
                vx = self.factors[i] * x[:, None]
                among = np.repeat(sums(vx, b), sizes, axis=0) - vx
                known, inverse = np.unique(i, return_inverse=True)
                g = np.bincount(inverse, weights=each) + decay * self.linear[known]
                seen[1][known] += g * g
                self.linear[known] -= rate * g / np.sqrt(seen[1][known])
                gv = np.stack([np.bincount(inverse, weights=each * among[:, f]) for f in range(RANK)], axis=1) + decay * self.factors[known]
                seen[2][known] += gv * gv
                self.factors[known] -= rate * gv / np.sqrt(seen[2][known])
                seen[0] += wrong.sum() ** 2
                self.bias -= rate * wrong.sum() / np.sqrt(seen[0])
        return self


def _stated(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def gathered(texts: Sequence[bytes], stated: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`features` of many texts, found piece by piece and held in 32 bits."""
    parts = [features(texts[a:b], stated[a:b]) for a, b in pieces(texts)]
    sizes = np.concatenate([np.diff(p[2]) for p in parts] or [np.zeros(0, np.int64)])
    index = np.concatenate([p[0].astype(np.int32) for p in parts] or [np.zeros(0, np.int32)])
    return index, np.concatenate([p[1].astype(np.float32) for p in parts] or [np.zeros(0, np.float32)]), ends(sizes)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fitted on labelled rows outside the held-out fold, at most ``rows`` of them."""
    got = labelled_sample(docs.withColumn("stated", _stated(docs)), labels, ["text", "stated"], held_out=False, rows=rows)
    texts = got["text"].cast("binary").fill_null(b"").to_pylist()
    return FactorisationMachine().fit(*gathered(texts, got["stated"].to_pylist()), np.array(got["quality"].to_pylist(), dtype=float) > 0)


def with_score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """``docs`` with the model's score, 0 to 1; ValueError if a column has that name."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, stated in batches:
            texts, stated = texts.tolist(), stated.tolist()
            yield pd.Series(np.concatenate([shared.value.score(texts[a:b], stated[a:b]) for a, b in pieces(texts, 500_000)] or [np.zeros(0)]))
            give_back()

    # Not to be evaluated once more where a filter on the score is pushed down.
    return docs.withColumn(name, score.asNondeterministic()(text_or_empty().cast("binary"), _stated(docs)))
