"""Quality rules: plain counts, and a logistic regression over hashed word and character n-grams.

The regression's features are the hashed word 1- and 2-grams and character 3-grams of a text, each
weighing the root of its share. It is fitted on a bounded
sample of labelled quality rows and calibrated (Platt) on the sample's third fold; the calibrated
probability is held against a fixed threshold.

Null texts count as empty: all counts 0, ``base_failed`` true, ``kept`` false. Very long texts are
measured whole, in numpy arrays of a few times their size. Without labelled rows every text has
probability 0.5 and passes the model. Repeated rows get the same result each; empty tables give empty
results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_CONTINUATION, IS_SPACE, Words, byte_table, ends, mix64, pieces, sums, text_or_empty
from .labelled import SAMPLE_ROWS, labelled_sample

#: Fixed values of the base rules.
SYMBOLS = byte_table(b"#*$%&|<>")
MIN_WORDS = 50
THRESHOLD = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

BITS = 18
CHARS = 3


def base_counts(texts: Sequence[bytes], words: Words) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = ends([len(t) for t in texts])
    inner = ~(IS_SPACE[flat] | IS_CONTINUATION[flat])
    lines = ([x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")] for t in texts)
    return {
        "n_words": words.counts,
        "word_chars": sums(inner.view(np.uint8), bounds),
        "n_symbols": sums(SYMBOLS[flat].view(np.uint8), bounds),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": sums(_repeated(words).view(np.uint8), words.bounds),
    }


def _repeated(words: Words, n: int = 3) -> np.ndarray:
    """Of each word, whether it stands in an n-word window that its text holds twice or more."""
    total = len(words.codes)
    out = np.zeros(total, dtype=bool)
    if total < n:
        return out
    owner = words.owners()
    inside = owner[: total - n + 1] == owner[n - 1 :]
    # Exact numbers for windows: the number of the first words, paired with the next word's, numbered anew.
    number, kinds = owner.astype(np.int64), len(words.bounds)
    width = len(words.unique) + 1
    window = number[: total - n + 1]
    for i in range(n):
        window = window * width + words.codes[i : total - n + 1 + i]
        window, found = pd.factorize(window)
        kinds = len(found)
    twice = (np.bincount(window[inside], minlength=kinds)[window] > 1) & inside
    for i in range(n):
        out[i : total - n + 1 + i] |= twice
    return out


def _char_grams(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    if len(points) < CHARS:
        return np.zeros(0, np.uint32), ends(np.zeros(len(texts)))
    h = points[: len(points) - CHARS + 1] * np.uint32(0x9E3779B1)
    for i in range(1, CHARS):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[i : len(points) - CHARS + 1 + i] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(points) - CHARS + 1] == owner[CHARS - 1 :]
    return (h >> np.uint32(32 - BITS))[inside], ends(np.maximum(sizes - CHARS + 1, 0))


def _word_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words at even places of the result, the pair that each begins at odd ones; the last word's pair is itself with an end."""
    h = mix64(words.hashes())[words.codes]
    after = np.concatenate([h[1:], np.zeros(min(1, len(h)), np.uint64)])
    last = words.bounds[1:][words.counts > 0] - 1
    after[last] = np.uint64(1)
    pair = mix64(h * np.uint64(3) + after)
    both = np.stack([h, pair], axis=1).reshape(-1)
    return (both >> np.uint64(64 - BITS)).astype(np.uint32), words.bounds * 2


def _weighed(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, gram and weight of each distinct gram of each text; weights are the roots of the shares, of unit length."""
    size = np.diff(bounds)
    pair, count = np.unique(np.repeat(np.arange(len(size)), size) << BITS | grams, return_counts=True)
    row = pair >> BITS
    return row, pair & ((1 << BITS) - 1), np.sqrt(count / size[row])


class NgramModel:
    """Weights of the two families of n-grams, and Platt's slope and offset."""

    def __init__(self) -> None:
        self.weights = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
        self.slope, self.offset = 1.0, 0.0

    def _margin(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        return sum(np.bincount(r, weights=w[i] * x, minlength=n) for w, (r, i, x) in zip(self.weights, grams, strict=True))

    def probability(self, texts: Sequence[bytes], words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self._margin([_weighed(*_word_grams(words)), _weighed(*_char_grams(texts))], len(texts)) + self.offset)))

    @staticmethod
    def _gathered(texts: Sequence[bytes], family) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:func:`_weighed` of many texts, found piece by piece and held in 32 bits."""
        parts = [(a, _weighed(*family(texts[a:b]))) for a, b in pieces(texts)]
        return np.concatenate([(a + p[0]).astype(np.int32) for a, p in parts]), np.concatenate([p[1].astype(np.int32) for _, p in parts]), np.concatenate([p[2].astype(np.float32) for _, p in parts])

    def fit(self, texts: Sequence[bytes], labels: np.ndarray, calibrate: np.ndarray, *, rounds: int = 60, rate: float = 0.15, decay: float = 1e-6) -> NgramModel:
        """Full-batch AdaGrad on the rows outside ``calibrate``; slope and offset by Newton's method on those in it."""
        n = len(texts)
        if not n:
            return self
        y, train = labels.astype(float), np.flatnonzero(~calibrate) if (~calibrate).any() else np.arange(n)
        active = np.zeros(n)
        active[train] = 1 / len(train)
        grams = [self._gathered(texts, family) for family in (lambda t: _word_grams(Words(t)), _char_grams)]
        bias, seen = 0.0, [np.full(1 << BITS, 1e-10) for _ in self.weights]

        for _ in range(rounds):
            wrong = (1 / (1 + np.exp(-(self._margin(grams, n) + bias))) - y) * active
            bias -= 2.0 * wrong.sum()
            for w, s, (r, i, x) in zip(self.weights, seen, grams, strict=True):
                g = np.bincount(i, weights=wrong[r] * x, minlength=len(w)) + decay * w
                s += g * g
                w -= rate * g / np.sqrt(s)
        check = np.flatnonzero(calibrate) if calibrate.any() else train
        m, t = self._margin(grams, n)[check], y[check]
        # Platt's targets keep the probabilities off 0 and 1.
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        scale = max(float(np.abs(m).mean()), 1e-9)
        x = np.stack([m / scale, np.ones_like(m)], axis=1)
        ab = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            ab -= np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
        self.slope, self.offset = float(ab[0] / scale), float(ab[1])
        self.weights = [w.astype(np.float32) for w in self.weights]
        return self


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> NgramModel:
    got = labelled_sample(docs, labels, ["text"], held_out=True, rows=rows)
    texts = got["text"].cast("binary").fill_null(b"").to_pylist()
    quality, fold = (np.array(got[c].to_pylist(), dtype=float) for c in ("quality", "fold"))
    return NgramModel().fit(texts, quality > 0, fold == 1)


def judge(docs: DataFrame, model: NgramModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``probability`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** BITS floats

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            parts = []
            for a, b in pieces(texts):
                words = Words(texts[a:b])
                parts.append(pd.DataFrame(base_counts(texts[a:b], words) | {"probability": shared.value.probability(texts[a:b], words)}))
            yield pd.concat(parts, ignore_index=True)

    failed = (F.col("r.n_words") < MIN_WORDS) | (100 * F.col("r.n_repeat_words") > 50 * F.col("r.n_words"))
    got = docs.select("doc_id", measure(text_or_empty().cast("binary")).alias("r"))
    return got.select("doc_id", *(f"r.{c}" for c in COUNTS), failed.alias("base_failed"), (~failed & (F.col("r.probability") >= threshold)).alias("kept"), "r.probability")
