"""Jaccard join of word shingles as a metric-space join.

The Jaccard distance d = 1 - J is a metric. Documents of equal shingle sets are one point, named by a
digest. Regions form around pivots, which are points themselves:

1.  Most points are at the full distance 1 from each other, so nearest pivots aren't searched among all
    of them. A point's prefix is its rarest shingles, as many as two sets of J >= t can't both miss
    (rarity from a count sketch of fixed size; any order serves, a rare-first one keeps what many
    documents share out of the prefixes). All points with a prefix shingle in common have the least
    of them as a pivot, so two linked points always share a pivot's region, and whoever has none of a
    pivot's shingles isn't near it.
2.  Each point has a signature: its shingles counted in about half as many buckets as it has shingles.
    The buckets' smaller counts add up to no less than the two sets have in common, so the signatures bound
    the distance from below; they are a sixteenth of the sets. Where the bound allows a link to the pivot, the
    distance is found exactly, from the whole sets. Links to pivots give components; a region all of
    whose points are in one component is done.
3.  Other regions are joined recursively. One of more than ``BLOCK`` points is split by pivots of its own:
    a point belongs to the Voronoi cell of its nearest pivot, or to what is left over if none is within
    ``RADIUS``. By the triangle inequality a point x of one cell can only be linked to a point of the
    cell of pivot p if d(x, p) exceeds neither d(x, its own pivot) by more than twice the links' distance
    nor RADIUS by more than once: where that holds, x is replicated to p's cell as a guest, in one
    direction, so that each pair of points meets once. Guests of one split aren't held against each
    other. Cells that are still too large are split again, in Spark rounds; before the first, sizes do the
    same, as distances from the empty set. What no pivot can split, because its points are near to each
    other, or what ``ROUNDS`` rounds leave too large is dealt into blocks, and each two blocks meet once:
    nothing is left out.
4.  Points whose signatures allow a link to another component stay, and each cell of those is joined in
    one loop: a point serves as the next pivot, is held against those of other components that no earlier
    pivot's window rules out, and leaves.

Every link between two components is found, or a path in its place: the components are exact. All links,
also those within a component, are what :func:`jaccard_links` and :func:`link_counts` give.

Null and empty texts have no shingles and are linked with nothing. Very long texts are shingled whole, a few
at a time. Repeated rows get the same result each; a null doc_id is never a component's smallest. Empty
tables give empty results; other columns, whatever their names, are ignored, or kept by
:func:`drop_near_copies`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .common import Words, ends, give_back, mix64, pieces, settings, slices, stored, sums, text_or_empty
from .components import components

SHINGLE = 5
PERCENT = 75
#: Sketches and filters have 2 ** bits counters, by the number of what they hold; they are summed in CHUNKS parts.
LEAST_BITS, MOST_BITS, CHUNKS = 21, 24, 32
#: The most points of a cell that is joined as it is.
BLOCK = 1000
#: How many pivots a cell is split by (a few more or less), within which distance they hold points, and how often it is split.
PIVOTS, RADIUS, ROUNDS = 16, 0.5, 5
#: Ends the name of a cell that pivots can't split: points that are near to each other, and yet of several components.
DENSE = "/dense"
#: Distances of links, with a margin for rounding.
NEAR = 1 - PERCENT / 100 + 1e-9
#: Rows that carry whole shingle sets go to Python in batches of so many.
SET_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

MULTIPLIER = 0x9E3779B97F4A7C15


def shingle_sets(texts: Sequence[bytes], n: int = SHINGLE, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; A-Z are lower-cased, no other letters."""
    words = Words([t.lower() for t in texts])
    h = mix64(words.hashes() + np.uint64(seed * 0x1234567 & 0xFFFFFFFF))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    total = len(h)
    rolled = np.zeros(max(total - n + 1, 0), np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(MULTIPLIER) + h[i : i + len(rolled)]
    rolled = mix64(rolled)
    found = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            found.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:  # the whole of a short text, apart from any longer one's shingles
            whole = np.uint64(b - a)
            for w in h[a:b]:
                whole = np.uint64(int(whole) * MULTIPLIER + int(w) & 0xFFFFFFFFFFFFFFFF)
            found.append(mix64(np.array([whole], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def digest(sets: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bounds = ends([len(s) for s in sets])
    full = bounds[1:] > bounds[:-1]
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        d = np.zeros(len(sets), np.uint64)
        if full.any():
            d[full] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), bounds[:-1][full])
        out.append(mix64(d).view(np.int64))
    return out[0], out[1]


def buckets(n: int) -> int:
    """How many buckets the signature of a set of n has."""
    return 1 << min(max((n // 2).bit_length(), 4), 14)


def signature(s: np.ndarray) -> np.ndarray:
    size = buckets(len(s))
    # Upper bits choose the bucket; 16 bits never overflow, as a bucket of a hashed set holds a few.
    return np.bincount((s >> np.uint64(50)).astype(np.int64) >> (14 - size.bit_length() + 1), minlength=size).astype("<u2")


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    return sig.reshape(size, -1).sum(axis=1) if len(sig) > size else sig


def may_link(n_x, n_y, common):
    """Whether sets of these sizes are linked, or can be if ``common`` is an upper bound."""
    return 100 * common >= PERCENT * (n_x + n_y - common)


def bits_for(n: int) -> int:
    """For a sketch or filter of n things: about 16 counters for each, within bounds; a fuller one costs time, never results."""
    return min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS)


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values & np.uint64((1 << bits) - 1)).astype(np.int64)


def _chunk_rows(counts: np.ndarray) -> list[tuple[int, bytes]]:
    return [(i, zlib.compress(c.astype("<u4").tobytes(), 1)) for i, c in enumerate(np.split(counts, CHUNKS)) if c.any()]


def _summed(chunks: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' counters, from ``chunk, counts`` rows; CHUNKS rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(counts), dtype="<u4").astype(np.int64)
                held[chunk] = held[chunk] + one if chunk in held else one
        for chunk, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], ["chunk", "counts"])

    total = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    for r in chunks.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        total[r["chunk"]] += np.frombuffer(r["counts"], dtype="<u4")
    return total.reshape(-1)


def _points(docs: DataFrame, seed: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_shingles, d1, d2, sig`` of each row, and the sketch of how many points have each shingle (copies count once a task)."""
    bits = bits_for(docs.count() // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "d1", "d2", "sig", "chunk", "counts"]
        counts = np.zeros(1 << bits, np.uint32)
        seen: set[int] = set()
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], seed=seed)
                d1, d2 = digest(sets)
                new = _unseen(d1, seen)
                slots, times = np.unique(_slots(np.concatenate([sets[i] for i in new] or [np.zeros(0, np.uint64)]), bits), return_counts=True)
                counts[slots] += times.astype(np.uint32)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(d1), pa.array(d2), pa.array([signature(x).tobytes() for x in sets], pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names)
        if rows := _chunk_rows(counts):
            k = len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    got = stored(rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary, chunk int, counts binary"), "points")
    return got.where("chunk is null").select("doc_id", "n_shingles", "d1", "d2", "sig"), _summed(got.where("chunk is not null").select("chunk", "counts"), bits)


def _unseen(names: np.ndarray, seen: set[int]) -> list[int]:
    """The places of names that this task hasn't met; they are added to ``seen``."""
    new = []
    for i, name in enumerate(names.tolist()):
        if name not in seen:
            seen.add(name)
            new.append(i)
    return new


def _prefixes(docs: DataFrame, sketch: np.ndarray, seed: int) -> DataFrame:
    """``d1, key`` for each point's prefix shingles, once a task however many copies it has."""
    bits = len(sketch).bit_length() - 1
    rarity = np.minimum(np.floor(8 * np.log2(sketch + 1.0)), 255).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # 2 ** bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = shared.value, set()
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], seed=seed)
                d1, _ = digest(sets)
                new = _unseen(d1, seen)
                keys, sizes = [np.zeros(0, np.uint64)], []
                for s in (sets[i] for i in new):
                    k = len(s) + (len(s) * PERCENT // -100) + 1 if len(s) else 0  # n - ceil(t n) + 1
                    order = rare[_slots(s, bits)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                    keys.append(s[np.argsort(order, kind="stable")[:k]])
                    sizes.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d1[new], np.array(sizes, dtype=np.int64))), pa.array(np.concatenate(keys).view(np.int64))], ["d1", "key"])

    return docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(run, "d1 long, key long")


def _members(ids: DataFrame, n: int) -> np.ndarray:
    """A filter for a column of n ids: false positives only."""
    bits = bits_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            counts[_slots(mix64(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)), bits)] = 1
        if rows := _chunk_rows(counts):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    return _summed(ids.mapInArrow(run, "chunk int, counts binary"), bits) > 0


def _sets(docs: DataFrame, points: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``d1, n, shingles`` (binary) of the points named in ``wanted``, once each, from the texts again."""
    # Copies collapse before the join, so that a text of many copies is one row in it.
    first = stored(points.groupBy("d1").agg(F.min("doc_id").alias("doc_id")).join(wanted, "d1", "left_semi"), "first")
    shared = docs.sparkSession.sparkContext.broadcast(_members(first.select("doc_id"), first.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, seen = shared.value, set()
        bits = len(member).bit_length() - 1
        for batch in slices(batches):
            names = batch.column(0).to_pylist()
            slots = _slots(mix64(np.array([n or 0 for n in names], dtype=np.int64).view(np.uint64)), bits)
            picked = [i for i, (n, s) in enumerate(zip(names, slots.tolist(), strict=True)) if n is None or member[s]]
            texts = batch.column(1).take(pa.array(picked, pa.int64())).to_pylist()
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], seed=seed)
                d1, _ = digest(sets)
                new = _unseen(d1, seen)
                yield pa.RecordBatch.from_arrays([pa.array(d1[new]), pa.array([len(sets[i]) for i in new], pa.int64()), pa.array([sets[i].tobytes() for i in new], pa.binary())], ["d1", "n", "shingles"])

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "d1 long, n long, shingles binary").join(wanted, "d1", "left_semi").dropDuplicates(["d1"])


def _near(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs ``x, p`` that their signatures allow to be linked."""
    at_p = pairs.join(signatures.select(F.col("d1").alias("p"), F.col("n").alias("n_p"), F.col("sig").alias("s_p")), "p")
    both = at_p.join(signatures.select(F.col("d1").alias("x"), F.col("n").alias("n_x"), F.col("sig").alias("s_x")), "x").where(f"100 * least(n_x, n_p) >= {PERCENT} * greatest(n_x, n_p)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_x, n_p, s_x, s_p = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = []
            for n, m, a, b in zip(n_x, n_p, s_x, s_p, strict=True):
                a, b = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
                size = min(len(a), len(b))
                keep.append(bool(may_link(n, m, int(np.minimum(folded(a, size), folded(b, size)).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "p"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    return both.select("x", "p", "n_x", "n_p", "s_x", "s_p").mapInArrow(run, "x long, p long")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, p, n_x, n_p, common`` of each pair ``x, p``, from the whole sets."""
    at_p = pairs.join(sets.select(F.col("d1").alias("p"), F.col("n").alias("n_p"), F.col("shingles").alias("s_p")), "p")
    both = at_p.join(sets.select(F.col("d1").alias("x"), F.col("n").alias("n_x"), F.col("shingles").alias("s_x")), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, p, n_x, n_p, s_x, s_p = (batch.column(i) for i in range(6))
            common = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(s_x.to_pylist(), s_p.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x, p, n_x, n_p, pa.array(common, pa.int64())], ["x", "p", "n_x", "n_p", "common"])
            give_back()

    return both.select("x", "p", "n_x", "n_p", "s_x", "s_p").mapInArrow(run, "x long, p long, n_x long, n_p long, common long")


def _find(parent: dict, a: int) -> int:
    while parent.setdefault(a, a) != a:
        parent[a] = a = parent[parent[a]]
    return a


def links_within(ids: np.ndarray, sets: list[np.ndarray], component: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components, between points whose masks have no bit in common.

    Each point in turn is the pivot, held against the later ones that are still in other components and that
    no window rules out: that of sizes, and those of the first few pivots.
    """
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = ends([len(s) for s in sets])
    size = np.diff(bounds)
    parent: dict[int, int] = {}
    here = np.zeros(len(values), dtype=bool)
    windows: list[np.ndarray] = []
    found = []
    for q in range(len(sets) - 1):
        later = np.arange(q + 1, len(sets))
        later = later[(mask[later] & mask[q]) == 0]
        root = np.array([_find(parent, int(c)) for c in component[later]])
        later = later[root != _find(parent, int(component[q]))]
        later = later[(100 * size[later] >= PERCENT * size[q]) & (100 * size[q] >= PERCENT * size[later])]
        for d in windows:
            # Distances that weren't taken are NaN and rule nothing out.
            later = later[~(np.abs(d[later] - d[q]) > NEAR)]
        if not len(later):
            continue
        here[flat[bounds[q] : bounds[q + 1]]] = True
        numbers, at = gather(flat, bounds, later)
        common = np.add.reduceat(here[numbers].astype(np.int64), at[:-1])
        here[flat[bounds[q] : bounds[q + 1]]] = False
        union = size[later] + size[q] - common
        if len(windows) < 8 and len(later) > 32:
            taken = np.full(len(sets), np.nan)
            taken[later], taken[q] = 1 - common / union, 0.0
            windows.append(taken)
        for y in later[100 * common >= PERCENT * union]:
            a, b = _find(parent, int(component[q])), _find(parent, int(component[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(ids[q]), int(ids[y])))
    return found


def with_partners(size: np.ndarray, sigs: list[np.ndarray], component: np.ndarray, mask: np.ndarray, meet=None) -> np.ndarray:
    """Of each point, whether its signature allows a link to one of another component whose mask has no bit in common.

    ``meet``, from :func:`meeting`, leaves out pairs that meet in another region.
    """
    out = np.zeros(len(sigs), dtype=bool)
    width = np.array([len(s) for s in sigs])
    for level in np.unique(width):
        # Linked sets differ by less than a factor of two: they have as many buckets, or one has twice as many.
        rows = np.flatnonzero((width == level) | (width == 2 * level))
        own = np.stack([folded(sigs[i], level) for i in rows])
        for k, q in enumerate(rows):
            if width[q] != level:
                continue
            # Pairs of equal width once; a wider one when this, the narrower, has its turn.
            other = (component[rows] != component[q]) & ((rows > q) | (width[rows] != level)) & (100 * np.minimum(size[rows], size[q]) >= PERCENT * np.maximum(size[rows], size[q]))
            other &= (mask[rows] & mask[q]) == 0
            at = np.flatnonzero(other)
            if meet and len(at):
                at = at[meet(q, rows[at])]
            if len(at):
                common = np.minimum(own[at], own[k]).sum(axis=1)
                hit = rows[at[may_link(size[rows[at]], size[q], common)]]
                if len(hit):
                    out[hit] = out[q] = True
    return out


def meeting(lesser: Sequence[Sequence[int]]):
    """From each point's pivots below the region's own: ``meet(q, others)``, which of these share none of them with q.

    Points that share several pivots meet in the region of the least one only.
    """
    values, flat = np.unique(np.array([p for own in lesser for p in own], dtype=np.int64), return_inverse=True)
    bounds = ends([len(own) for own in lesser])
    here = np.zeros(len(values), dtype=bool)

    def meet(q: int, others: np.ndarray) -> np.ndarray:
        own = flat[bounds[q] : bounds[q + 1]]
        if not len(own):
            return np.ones(len(others), dtype=bool)
        here[own] = True
        numbers, at = gather(flat, bounds, others)
        shared = sums(here[numbers].astype(np.int64), at)
        here[own] = False
        return shared == 0

    return meet


def all_within(sets: list[np.ndarray], mask: np.ndarray, meet) -> Iterator[tuple[int, np.ndarray]]:
    """``q, linked``: all links between points whose masks have no bit in common, each once, by place in the cell."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = ends([len(s) for s in sets])
    size = np.diff(bounds)
    here = np.zeros(len(values), dtype=bool)
    for q in range(len(sets) - 1):
        later = np.arange(q + 1, len(sets))
        later = later[(mask[later] & mask[q]) == 0]
        later = later[(100 * size[later] >= PERCENT * size[q]) & (100 * size[q] >= PERCENT * size[later])]
        later = later[meet(q, later)]
        if not len(later):
            continue
        own = flat[bounds[q] : bounds[q + 1]]
        here[own] = True
        numbers, at = gather(flat, bounds, later)
        common = np.add.reduceat(here[numbers].astype(np.int64), at[:-1])
        here[own] = False
        linked = later[may_link(size[later], size[q], common)]
        if len(linked):
            yield q, linked


#: What a point is in a cell: the cell's name, the region, the point, its size and component, and its mask.
CELL = "cell string, p long, x long, n long, root long, mask long"
CELL_NAMES = [c.split(" ")[0] for c in CELL.split(", ")]


def _by_cell(rows: DataFrame, content: str, work, schema: str) -> DataFrame:
    """``work(cell, p, x, n, root, mask, contents)`` of each cell gives rows; cells stream through the tasks in order.

    Most cells hold a few points: they are cut from whole Arrow batches, without a frame of their own each.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(table: pa.Table, whole: bool):
            columns = [table.column(i).to_numpy() for i in range(6)]
            contents = table.column(6).to_pylist()
            cell, p, x, n, root, mask = columns
            starts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(p)]
            last = len(starts) - (1 if whole else 2)
            found = [r for a, b in zip(starts[:last], starts[1 : last + 1], strict=True) for r in work(cell[a], p[a], x[a:b], n[a:b], root[a:b], mask[a:b], contents[a:b])]
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)
            return made, table.slice(starts[last]) if not whole else None

        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                made, held = results(table if held is None else pa.concat_tables([held, table]), False)
                yield made
                give_back()
        if held is not None:
            yield results(held, True)[0]
        held = None
        give_back()

    return rows.select(*CELL_NAMES, content).repartition("cell").sortWithinPartitions("cell", "x").mapInArrow(run, schema)


class Pivots:
    """The sets of a cell's pivots, and distances to all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.values, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    @staticmethod
    def tell_apart(sets: list[np.ndarray]) -> bool:
        """Whether pivots drawn from a cell can split it: not if more than a quarter of their pairs are so near that their points visit each other."""
        pivots = Pivots(sets)
        near = sum(int((pivots.distances(s) <= RADIUS + NEAR).sum()) - 1 for s in sets)
        return len(sets) > 1 and 4 * near <= len(sets) * (len(sets) - 1)

    def distances(self, s: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        held = last > first
        first, count = first[held], (last - first)[held]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))
        return 1 - common / (self.size + len(s) - common)


def cells_of(d: np.ndarray) -> tuple[int, list[int]]:
    """The Voronoi cell of a point by its distances to the pivots, -1 if none is within RADIUS, and the later cells that it visits."""
    home = int(d.argmin()) if len(d) and d.min() <= RADIUS else -1
    reach = np.full(len(d), RADIUS + NEAR)
    if home >= 0:
        reach = np.minimum(reach, d[home] + 2 * NEAR)
    visits = np.flatnonzero(d <= reach)
    return home, visits[visits > home].tolist()


def _split(big: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """Cells too large (with ``n_cell``, their number of points) split by pivots drawn from them by hash; bit ``number`` marks guests."""
    rows = big.join(sets.select(F.col("d1").alias("x"), "shingles"), "x")
    parts = F.ceil(F.col("n_cell") / BLOCK).cast("int")
    names = [c for c in CELL_NAMES if c != "cell"]
    members = rows.select("cell", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"), F.lit(1).alias("member"), *names, "shingles")
    pivots = rows.where(F.pmod(F.xxhash64("x", F.lit(number)), F.col("n_cell")) < PIVOTS)
    pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("member"), *names, "shingles")
    bit = 1 << number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, pivots, split = None, [], None, False
        for batch in batches:
            out: list[tuple] = []
            for cell, part, member, p, x, n, root, mask, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, part) != here:
                    here, held, pivots = (cell, part), [], None
                own = np.frombuffer(shingles, np.uint64)
                if not member:
                    held.append(own)
                    continue
                if pivots is None:
                    pivots, split = Pivots(held), Pivots.tell_apart(held)
                if not split:  # the same in all parts of the cell, as it depends on the pivots alone
                    out.append((f"{cell}{DENSE}", p, x, n, root, mask))
                    continue
                home, visits = cells_of(pivots.distances(own))
                out.append((f"{cell}/{number}.{home}", p, x, n, root, mask))
                out += [(f"{cell}/{number}.{j}", p, x, n, root, mask | bit) for j in visits]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k == 0 else pa.int64()) for k in range(6)], CELL_NAMES)
            give_back()

    dealt = members.unionByName(pivots).select("cell", "part", "member", *names, "shingles")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "member", "x").mapInArrow(run, CELL)


def _cells(members: DataFrame, docs: DataFrame, points: DataFrame, seed: int, *, open_only: bool) -> DataFrame:
    """The points ``p, x, n, root`` of regions dealt to cells of at most BLOCK points, in rows of ``CELL``.

    open_only: whether cells whose points are all of one component can be left out.
    """
    cells = members.select(F.col("p").cast("string").alias("cell"), "p", "x", "n", "root", F.lit(0).cast("long").alias("mask"))
    sets = None
    for number in range(ROUNDS + 2):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n_cell"), (F.min("root") != F.max("root")).alias("open"))
        if open_only:
            sizes = sizes.where("open")
        sizes = stored(sizes.drop("open"), "cell-sizes")
        sized = cells.join(sizes, "cell")
        wide, dense = F.col("n_cell") > BLOCK, F.col("cell").endswith(DENSE)
        last = number > ROUNDS or sizes.where(wide & ~dense).isEmpty()
        if last and sizes.where(wide).isEmpty():
            return sized.select(*CELL_NAMES)
        chosen = wide if last else wide & ~dense
        big, small = sized.where(chosen), sized.where(~chosen)
        if last:
            # What is too large still meets by pairs of blocks.
            blocks = F.ceil(F.col("n_cell") / BLOCK).cast("int")
            rows = big.withColumn("block", F.pmod(F.xxhash64("x"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            side = F.when(F.col("block") < F.col("other"), 1 << 40).when(F.col("block") > F.col("other"), 1 << 41).otherwise(0).cast("long")
            parts = rows.select(F.concat_ws("/", "cell", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")).alias("cell"), "p", "x", "n", "root", F.col("mask").bitwiseOR(side).alias("mask"))
            return small.select(*CELL_NAMES).unionByName(parts.select(*CELL_NAMES))
        if number == 0:
            # Sizes of linked points are in one band or in neighbouring ones: a band's points are guests of the one below.
            band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
            ways = F.array(F.struct(band.alias("band"), F.col("mask").alias("mask")), F.struct((band - 1).alias("band"), F.col("mask").bitwiseOR(F.lit(1).cast("long")).alias("mask")))
            parts = big.withColumn("way", F.explode(ways)).select(F.concat_ws("/", "cell", F.col("way.band").cast("string")).alias("cell"), "p", "x", "n", "root", F.col("way.mask").alias("mask"))
        else:
            sets = sets or stored(_sets(docs, points, big.select(F.col("x").alias("d1")).distinct(), seed), "sets")
            parts = _split(big, sets, number)
        cells = stored(small.select(*CELL_NAMES).unionByName(parts.select(*CELL_NAMES)), "cells")
    return cells


def _region_links(pairs: DataFrame, roots: DataFrame, docs: DataFrame, points: DataFrame, signatures: DataFrame, seed: int) -> DataFrame:
    """``a, b``: links between components, from the regions that hold points of several."""
    named = signatures.select(F.col("d1").alias("x"), "n").join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    members = stored(pairs.unionByName(pairs.select(F.col("p").alias("x"), "p").distinct()).join(named, "x"), "members")
    cells = _cells(members, docs, points, seed, open_only=True)

    def keep(cell, p, x, n, root, mask, sigs):
        stay = with_partners(n, [np.frombuffer(s, "<u2") for s in sigs], root, mask)
        return [(cell, p, *r) for r in zip(x[stay].tolist(), n[stay].tolist(), root[stay].tolist(), mask[stay].tolist(), strict=True)]

    left = stored(_by_cell(cells.join(signatures.select(F.col("d1").alias("x"), "sig"), "x"), "sig", keep, CELL), "left")
    sets = stored(_sets(docs, points, left.select(F.col("x").alias("d1")).distinct(), seed), "sets")

    def join(cell, p, x, n, root, mask, sets):
        return links_within(x, [np.frombuffer(s, np.uint64) for s in sets], root, mask)

    return _by_cell(left.join(sets.select(F.col("d1").alias("x"), "shingles"), "x"), "shingles", join, "a long, b long")


def jaccard_components(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row; links are of J >= PERCENT / 100."""
    with settings(docs.sparkSession, SET_BATCH):
        points, sketch = _points(docs, seed)
        clash = points.where("n_shingles > 0").groupBy("d1").agg(F.min("d2").alias("a"), F.max("d2").alias("b")).where("a <> b")
        if not clash.isEmpty():  # two sets of one name: hash anew
            return jaccard_components(docs, seed=seed + 1)
        # Read twice, and made twice: written, the prefixes would take more disk than making them takes time.
        prefixes = _prefixes(docs, sketch, seed)
        shared = prefixes.groupBy("key").agg(F.min("d1").alias("p"), F.max("d1").alias("most")).where("p <> most").select("key", "p")
        pairs = stored(prefixes.join(shared, "key").where("d1 <> p").select(F.col("d1").alias("x"), "p").distinct(), "pairs")
        wanted = pairs.select(F.col("x").alias("d1")).unionByName(pairs.select(F.col("p").alias("d1"))).distinct()
        signatures = stored(points.where("n_shingles > 0").groupBy("d1").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).join(wanted, "d1", "left_semi"), "signatures")
        near = stored(_near(pairs, signatures), "near")
        wanted = near.select(F.col("x").alias("d1")).unionByName(near.select(F.col("p").alias("d1"))).distinct()
        sets = stored(_sets(docs, points, wanted, seed), "sets")
        links = stored(_distances(near, sets).where(may_link(F.col("n_x"), F.col("n_p"), F.col("common"))).select(F.col("x").alias("a"), F.col("p").alias("b")), "links")
        roots = components(links)
        more = stored(_region_links(pairs, roots, docs, points, signatures, seed), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    named = points.join(roots.withColumnRenamed("node", "d1"), "d1", "left").withColumn("c", F.coalesce("root", "d1"))
    linked = named.where("n_shingles > 0")
    # Written, so that the join below is one of two plain tables, whose large keys Spark can split.
    least = stored(linked.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    out = linked.join(least, "c").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(points.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _all_links(docs: DataFrame, work, schema: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What ``work(ids, copies, q, linked)`` gives for all links, in rows of ``schema``, and the points of :func:`_points`.

    Unlike :func:`jaccard_components` it holds all points of a region against each other, whatever component they are of.
    """
    points, sketch = _points(docs, seed)
    clash = points.where("n_shingles > 0").groupBy("d1").agg(F.min("d2").alias("a"), F.max("d2").alias("b")).where("a <> b")
    if not clash.isEmpty():  # two sets of one name: hash anew
        return _all_links(docs, work, schema, seed + 1)
    prefixes = _prefixes(docs, sketch, seed)
    shared = prefixes.groupBy("key").agg(F.min("d1").alias("p"), F.max("d1").alias("most")).where("p <> most").select("key", "p")
    pairs = stored(prefixes.join(shared, "key").where("d1 <> p").select(F.col("d1").alias("x"), "p").distinct(), "pairs")
    members = pairs.unionByName(pairs.select(F.col("p").alias("x"), "p").distinct())
    signatures = points.where("n_shingles > 0").groupBy("d1").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("root"))
    signatures = stored(signatures.withColumnRenamed("d1", "x").join(members.select("x").distinct(), "x", "left_semi"), "signatures")
    pivots = stored(pairs.groupBy("x").agg(F.collect_list("p").alias("pivots")), "pivots")

    def with_content(cells: DataFrame, contents: DataFrame, name: str) -> DataFrame:
        """Cells, each point with its content and its pivots below the region's own."""
        at = cells.join(contents, "x").join(pivots, "x", "left")
        lesser = F.filter(F.coalesce("pivots", F.array().cast("array<long>")), lambda v: v < F.col("p"))
        return at.withColumn("content", F.struct(F.col(name).alias("own"), lesser.alias("lesser")))

    # Each point with its copies in the place of a root.
    cells = _cells(members.join(signatures.select("x", "n", "root"), "x"), docs, points, seed, open_only=False)

    def keep(cell, p, x, n, copies, mask, contents):
        stay = with_partners(n, [np.frombuffer(c["own"], "<u2") for c in contents], x, mask, meeting([c["lesser"] for c in contents]))
        return [(cell, p, *r) for r in zip(x[stay].tolist(), n[stay].tolist(), copies[stay].tolist(), mask[stay].tolist(), strict=True)]

    left = stored(_by_cell(with_content(cells, signatures.select("x", "sig"), "sig"), "content", keep, CELL), "left")
    sets = stored(_sets(docs, points, left.select(F.col("x").alias("d1")).distinct(), seed), "sets")

    def join(cell, p, x, n, copies, mask, contents):
        return work(x, copies, all_within([np.frombuffer(c["own"], np.uint64) for c in contents], mask, meeting([c["lesser"] for c in contents])))

    return stored(_by_cell(with_content(left, sets.select(F.col("d1").alias("x"), "shingles"), "shingles"), "content", join, schema), "all-links"), points


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links ``a, b`` between distinct shingle sets, each once and named by digest, and ``doc_id, d1``: the set of each row that has one.

    Rows of one set are linked with each other too. The links within a group grow with the square of its distinct sets.
    """

    def pairs(x, copies, found):
        return [(min(a, b), max(a, b)) for q, linked in found for a, b in zip([int(x[q])] * len(linked), x[linked].tolist(), strict=True)]

    with settings(docs.sparkSession, SET_BATCH):
        links, points = _all_links(docs, pairs, "a long, b long")
    return links, points.where("n_shingles > 0").select("doc_id", "d1")


def link_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, n_links`` of each row: how many other rows it is linked with, copies included.

    Counts are added up within each window, so no table of pairs is made.
    """

    def counts(x, copies, found):
        total = np.zeros(len(x), np.int64)
        for q, linked in found:
            total[q] += copies[linked].sum()
            total[linked] += copies[q]
        return list(zip(x[total > 0].tolist(), total[total > 0].tolist(), strict=True))

    with settings(docs.sparkSession, SET_BATCH):
        found, points = _all_links(docs, counts, "x long, linked long")
    linked = points.where("n_shingles > 0")
    own = linked.groupBy("d1").agg((F.count("*") - 1).alias("linked"))
    total = stored(own.unionByName(found.withColumnRenamed("x", "d1")).groupBy("d1").agg(F.sum("linked").alias("n_links")).where("n_links > 0"), "link-counts")
    out = linked.join(total, "d1", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out.unionByName(points.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; the same columns.

    A row is dropped by its doc_id, which is taken to name one text; rows without one stay.
    """
    gone = stored(jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "near-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select("row.*")
