"""BPE encoding in batched numpy merge rounds, and decoding.

For vocabularies of the ``tokenizers`` library with word ends and byte-level symbols: a text is
normalised (NFC, lower case letter by letter), cut into words by the file's pattern, and each
distinct word is merged by rank. The symbols of many words lie in one flat array; a round looks all
neighbouring pairs up by binary search over the sorted pair keys, takes each word's lowest rank, and
merges its places. Words without a further merge leave the array.

Strings of special tokens are cut out of the raw text first, as the library does. Null and empty
texts have no ids and decode to an empty text. Repeated rows get the same result each; empty tables
give empty results; very long texts are encoded whole; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ends, pieces, slices, text_or_empty

#: Chunks of text whose ids a Python worker remembers, at most; beyond that it forgets those it met but once.
REMEMBERED = 300_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: A text is cut at these first; no word of the pattern holds any of them.
CHUNKS = re.compile(r"[^ \t-\r]+").findall
#: Letters of these ranges are the same in every Unicode version at hand. Anything else goes through the
#: library's own normaliser and pattern, as its tables may be older or newer than Python's.
OTHERS = re.compile("[^\u0000-\u0377\u0391-\u03a1\u03a3-\u0527\u05d0-\u05ea\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fea\uac00-\ud7a3\U0001f300-\U0001f64f]").search


class Cutter:
    """From a text to chunks without white space, and from a chunk to its words by the file's pattern.

    Special tokens stay whole, with SPECIAL before them. Chunks are a text's, normalised; most texts repeat them.
    """

    #: No chunk holds white space, so a normalised chunk of a special token's letters is another string.
    SPECIAL = " "

    def __init__(self, path: str, spec: dict):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if OTHERS(text):
            return self.normalise(text)
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: a final sigma isn't a case of its own.
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def chunks(self, text: str) -> list[str]:
        if not self.cut or not any(s in text for s in self.special):
            return CHUNKS(self.normal(text))
        found: list[str] = []
        for part in self.cut(text):
            found += [self.SPECIAL + part] if part in self.special else CHUNKS(self.normal(part))
        return found

    def words(self, chunk: str) -> list[str]:
        return [w for w, _ in self.split(chunk)] if not chunk.isascii() and OTHERS(chunk) else self.find(chunk)


class Merges:
    """The vocabulary's pairs in the order of their keys, and the rounds over words."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A pair of a merged symbol must rank after the merge that makes it; then all places of a word's
        # lowest pair may be merged in one round, as nothing of a lower rank comes between them.
        first = np.full(int(made.max()) + 1 if len(made) else 1, len(pairs), dtype=np.int64)
        for side in (left, right):
            known = side < len(first)
            np.minimum.at(first, side[known], np.flatnonzero(known))
        self.at_once = bool((first[made] > np.arange(len(pairs))).all())
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order, made[order]

    def encode(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, flat, and the bounds of each."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.ranks)
        # Of each symbol's pair with the next one: its place among the keys and its rank.
        at, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), none, dtype=np.int64)
        changed = np.arange(len(symbols))
        while len(symbols):
            after = np.minimum(changed + 1, len(symbols) - 1)
            key = symbols[changed] << 32 | symbols[after]
            place = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[place] == key) & (word[changed] == word[after]) & (after > changed)
            at[changed], rank[changed] = place, np.where(hit, self.ranks[place], none)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([starts, [len(word)]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), size)
            over = lowest == none
            if over.any():
                done.append((word[over], symbols[over]))
            here = np.flatnonzero((rank == lowest) & ~over)
            if not len(here):
                break
            new = np.diff(here) != 1 if self.at_once else word[here][1:] != word[here][:-1]
            run = np.flatnonzero(np.concatenate([[True], new]))
            nth = np.arange(len(here)) - np.repeat(run, np.diff(np.concatenate([run, [len(here)]])))
            # Of overlapping places, as in a run of one letter, every other one; or a word's first place only.
            here = here[nth % 2 == 0] if self.at_once else here[nth == 0]
            symbols[here] = self.made[at[here]]
            stay = ~over
            stay[here + 1] = False
            moved = np.cumsum(stay) - 1
            changed = np.unique(np.concatenate([moved[here], np.maximum(moved[here] - 1, 0)]))
            symbols, word, at, rank = symbols[stay], word[stay], at[stay], rank[stay]
        word, symbols = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], ends(np.bincount(word, minlength=len(words)))


def by_words(encode):
    """From ``encode`` for distinct words to the same for chunks of one or more words."""

    def encode_chunks(chunks: Sequence[str], cutter: Cutter) -> tuple[np.ndarray, np.ndarray]:
        cut = [cutter.words(c) for c in chunks]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for words in cut for w in words], dtype=np.int64)
        ids, bounds = encode([*number])
        ids, at = gather(ids, bounds, flat)
        return ids, at[ends([len(words) for words in cut])]

    return encode_chunks


def gather(values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices number ``chosen`` of ``values``, one after the other, and their bounds."""
    size = (bounds[1:] - bounds[:-1])[chosen]
    at = ends(size)
    return values[np.repeat(bounds[chosen] - at[:-1], size) + np.arange(at[-1])], at


class Numbers(dict):
    """Numbers for strings in the order of their first use; ``new`` has those not seen before."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


@contextmanager
def without_collector() -> Iterator[None]:
    """Without searches for cycles: encoding makes many small objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class TextEncoder:
    """Ids of whole texts. ``encode_chunks`` gives the flat ids and bounds of distinct chunks."""

    def __init__(self, cutter: Cutter, encode_chunks, remembered: int = REMEMBERED):
        self.cutter, self.encode_chunks, self.remembered = cutter, encode_chunks, remembered
        self.number, self.ids, self.bounds, self.used = Numbers(), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        for name, i in cutter.special.items():
            self._learn(np.array([i]), np.array([0, 1])) if self.number[cutter.SPECIAL + name] >= 0 else None
        self.number.new.clear()

    def forget(self) -> None:
        """Keep special tokens and what was met often enough: more than once, or more, until half is gone."""
        special, often = len(self.cutter.special), 1
        while (self.used > often).sum() > self.remembered // 2:
            often *= 2
        keep = np.flatnonzero((self.used > often) | (np.arange(len(self.used)) < special))
        names, number = [*self.number], Numbers()
        for i in keep.tolist():
            number[names[i]] = len(number)
        self.ids, self.bounds = gather(self.ids, self.bounds, keep)
        self.number, self.used = number, self.used[keep] // 2

    def _learn(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    @without_collector()
    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and the bounds of each."""
        if len(self.number) > self.remembered:
            self.forget()
        cut, chunks, counts = self.cutter.chunks, [], []
        for t in texts:
            found = cut(t)
            chunks += found
            counts.append(len(found))
        number = np.fromiter(map(self.number.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if self.number.new:
            self._learn(*self.encode_chunks(self.number.new, self.cutter))
            self.number.new.clear()
        met = np.bincount(number, minlength=len(self.number))
        met[: len(self.used)] += self.used
        self.used = met
        ids, at = gather(self.ids, self.bounds, number)
        return ids, at[ends(counts)]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[TextEncoder, dict[int, str]]:
    """The encoder of a vocabulary file and the text of each id; one for each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = Merges(spec)
    return TextEncoder(Cutter(path, spec), by_words(merges.encode)), merges.token


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of each row. The vocabulary file is read from ``path`` on every machine.

    Decoded is what the library's decode() makes of files without a decoder: the tokens joined by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, token = load(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts):
                ids, bounds = encoder.encode(texts[a:b])
                listed = ids.tolist()
                strings = [*map(token.__getitem__, listed)]
                decoded = [" ".join(strings[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what :func:`encode_decode` returns, and ``more`` of its columns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
