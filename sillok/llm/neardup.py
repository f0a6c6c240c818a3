"""Near-duplicate texts: banded MinHash candidates, odd-sketch screening, exact Jaccard on whole texts.

Rows with equal word sequences form one class, so copies are never compared with each other. A class representative gets MinHash
samples; bands of samples propose candidate pairs. Chance collisions grow as the square of the texts, so they end inside the join of the cells, by one bit of each of 256 samples that
every entry carries, before a pair is written anywhere. The same samples folded into a parity bitmap (odd sketch) give, by the population count of the XOR of
two bitmaps, an estimate that is sharp at high similarities and screens what is left; the rest is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillok.session import rows_of, scratch_path, stored

#: Most bands a plan may use; the rows of a band follow from it.
MAX_BANDS = 66
SKETCH_BITS = 1024
#: Samples of which each entry of a cell carries one bit, a multiple of 64.
ENTRY_BITS = 256
#: Entries of cells that one pass over the bands shuffles, about, and the most passes; more passes need less disk at a time, each shuffles 1 / passes of the entries.
ENTRIES_AT_ONCE = 6_000_000
MAX_PASSES = 6
#: Most ids of screened candidates that are broadcast to the scan of the texts; beyond it that join shuffles.
BROADCAST_IDS = 400_000


@dataclass(frozen=True)
class Likeness:
    """What counts as alike: runs of ``shingle`` words, Jaccard at least ``threshold``, candidates missed at the threshold at most ``miss``."""

    shingle: int = 5
    threshold: float = 0.8
    miss: float = 0.005
    seed: int = 20_260_302
    rows: int = field(init=False)
    bands: int = field(init=False)
    most_odd: int = field(init=False)
    most_unlike: int = field(init=False)

    def __post_init__(self) -> None:
        need = lambda r: math.ceil(math.log(self.miss) / math.log1p(-(self.threshold**r)))
        rows = max(r for r in range(1, 33) if need(r) <= MAX_BANDS)
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "bands", need(rows))
        # parity bits that differ at the threshold: mean plus 4.5 deviations of sketch and samples
        k, n, j = rows * need(rows), SKETCH_BITS, self.threshold
        left = math.exp(-4 * k * (1 - j) / n)
        spread = math.sqrt(n * (1 - left * left) / 4 + (2 * left) ** 2 * k * j * (1 - j))
        object.__setattr__(self, "most_odd", math.ceil(n * (1 - left) / 2 + 4.5 * spread))
        # bits of an entry that differ at the threshold: mean plus 4.5 deviations; unlike samples agree in half of their bits
        m, p = min(k, ENTRY_BITS), (1 - j) / 2
        object.__setattr__(self, "most_unlike", math.ceil(m * p + 4.5 * math.sqrt(m * p * (1 - p))))

    @property
    def samples(self) -> int:
        return self.rows * self.bands


def words(text: Column) -> Column:
    """Words between spaces, tabs and newlines, otherwise as stored."""
    spaced = F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" "))  # a split at one character needs no pattern
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def plain_text(*columns: str) -> Column:
    """The columns joined by spaces, null as empty, in single spaces; empty texts stay empty."""
    return F.array_join(words(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), " ")


def _fingerprints(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of the word runs of each text: values, owner of each, and distinct ones sorted by owner and value."""
    split = pc.split_pattern(pc.cast(texts, pa.large_string()), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = pc.dictionary_encode(split.flatten())
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashed = distinct[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    # a text shorter than a run is one run of its own
    runs = np.maximum(lengths - shingle + 1, 1)
    owner = np.repeat(np.arange(len(lengths)), runs)
    start = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    stop = np.repeat(offsets[1:], runs)
    value = np.full(len(start), 0x9E3779B97F4A7C15, np.uint64)
    padded = np.append(hashed, np.zeros(shingle, np.uint64))
    for k in range(shingle):
        at = start + k
        value = (value ^ np.where(at < stop, padded[np.minimum(at, len(padded) - 1)], np.uint64(k))) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, owner, np.bincount(owner, minlength=len(lengths))


def _bit_of_samples(mixed: np.ndarray) -> np.ndarray:
    """One bit of each of the first ENTRY_BITS samples, as longs of one row a text."""
    bits = np.zeros((mixed.shape[1], ENTRY_BITS), np.uint8)
    bits[:, : len(mixed)] = ((mixed[:ENTRY_BITS] >> np.uint64(40)) & np.uint64(1)).T
    return np.packbits(bits, axis=1).view(np.int64)


def _signature_batches(like: Likeness):
    rng = np.random.default_rng(like.seed)
    salt = rng.integers(0, 2**32, like.samples, dtype=np.uint32)
    odd = rng.integers(0, 2**32, like.samples, dtype=np.uint32) | np.uint32(1)
    mix = rng.integers(0, 2**63, like.samples, dtype=np.uint64) | np.uint64(1)

    def one(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        value, _, sizes = _fingerprints(texts, like.shingle)
        short = (value >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        low = np.empty((like.samples, len(sizes)), np.uint32)
        for k in range(like.samples):
            low[k] = np.minimum.reduceat((short ^ salt[k]) * odd[k], starts)
        mixed = (low.astype(np.uint64) + np.arange(1, like.samples + 1, dtype=np.uint64)[:, None]) * mix[:, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        cells = np.zeros((like.bands, len(sizes)), np.uint64)
        for r in range(like.rows):
            cells = (cells ^ mixed[r * like.bands : (r + 1) * like.bands]) * np.uint64(0x94D049BB133111EB)
            cells ^= cells >> np.uint64(31)
        spot = (mixed % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(sizes)) * SKETCH_BITS
        parity = np.bincount(spot.ravel(), minlength=len(sizes) * SKETCH_BITS).astype(np.uint8) & 1
        sketch = np.packbits(parity).view(np.int64).reshape(len(sizes), SKETCH_BITS // 64)
        return sizes, cells.T.copy().view(np.int64), sketch, _bit_of_samples(mixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sizes, cells, sketch, bits = one(part.column("text"))
                lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
                extra = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*extra, pa.array(sizes.astype(np.int32)), lists(sketch), lists(bits), lists(cells)], names=[*part.schema.names, "size", "sketch", "bits", "cells"])

    return run


def signatures(rows: DataFrame, like: Likeness) -> DataFrame:
    """``rep, key, text, size, sketch, bits, cells`` of rows ``id, text`` (``rep`` the id): digest, distinct runs, odd sketch, bits of samples and band keys, in Arrow batches where the rows lie, without a shuffle."""
    keyed = rows.select(F.col("id").alias("rep"), F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(_signature_batches(like), "rep long, key binary, text string, size int, sketch array<long>, bits array<long>, cells array<long>")


def copies_of(signed: DataFrame) -> DataFrame:
    """``id, rep`` of the rows whose text another row has too, ``rep`` the smallest of them. Only digests move, and a hot text is one entry a task."""
    keys = signed.select(F.col("rep").alias("id"), "key")
    shared = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(shared, "key").select("id", "rep")


def representatives(signed: DataFrame, copies: DataFrame) -> DataFrame:
    """The signed rows without the later copies of a text (``copies``: stored)."""
    later = copies.filter("id <> rep").select(F.col("id").alias("rep"))
    return signed.join(F.broadcast(later) if rows_of(copies) <= BROADCAST_IDS else later, "rep", "left_anti")


def passes(rows: int, like: Likeness) -> list[range]:
    """The bands of each pass over the cells of at most ``rows`` texts."""
    n = max(1, min(MAX_PASSES, like.bands, -(-rows * like.bands // ENTRIES_AT_ONCE)))
    return [range(i * like.bands // n, (i + 1) * like.bands // n) for i in range(n)]


def entries(signed: DataFrame, bands: range, *more: str) -> DataFrame:
    """One row per class and band: ``cell, rep``, the bits of samples and the columns ``more``. The band is mixed into the key, so one exchange serves all bands."""
    bits = [F.col("bits")[i].alias(f"bits_{i}") for i in range(ENTRY_BITS // 64)]
    each = signed.select(F.posexplode(F.slice("cells", bands.start + 1, len(bands))).alias("at", "key"), "rep", *bits, *more)
    return each.select(F.xxhash64(F.col("at") + F.lit(bands.start), "key").alias("cell"), "rep", *[f"bits_{i}" for i in range(ENTRY_BITS // 64)], *more)


def bits_allow(like: Likeness) -> Column:
    """Whether the bits of the entries ``l`` and ``r`` of a cell leave room for the threshold."""
    return sum((F.bit_count(F.col(f"l.bits_{i}").bitwiseXOR(F.col(f"r.bits_{i}"))) for i in range(ENTRY_BITS // 64)), F.lit(0)) <= like.most_unlike


def candidates(signed: DataFrame, rows: int, like: Likeness) -> DataFrame:
    """Distinct pairs ``a < b`` of the classes (at most ``rows``) that share a cell and whose bits allow the threshold. Both sides are one exchange; a hot cell is split by the adaptive skew join."""
    met = []
    for bands in (every := passes(rows, like)):
        cells = entries(signed, bands)
        pairs = cells.alias("l").join(cells.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.rep") < F.col("r.rep")) & bits_allow(like))
        pairs = pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
        met.append(stored(pairs, scratch_path(signed.sparkSession, "pass")) if len(every) > 1 else pairs)
    return met[0] if len(met) == 1 else reduce(DataFrame.unionByName, met).distinct()


def sizes_allow(a: Column, b: Column, like: Likeness) -> Column:
    """Whether two numbers of distinct runs leave room for the threshold: Jaccard is at most their ratio."""
    return F.least(a, b) >= F.lit(like.threshold - 1e-9) * F.greatest(a, b)


def wanted(pairs: DataFrame, texts: DataFrame, *sides: str) -> DataFrame:
    """The rows of ``texts`` that stand in ``sides`` of the stored pairs, filtered where they lie while the ids may be broadcast."""
    ids = pairs.select(F.explode(F.array(*sides)).alias("rep"))
    return texts.join(F.broadcast(ids) if rows_of(pairs) * len(sides) <= BROADCAST_IDS else ids, "rep", "left_semi")


def screened(pairs: DataFrame, left: DataFrame, right: DataFrame, like: Likeness, *keep: str) -> DataFrame:
    """The pairs (``a`` in ``left``, ``b`` in ``right``) whose sizes and odd sketches allow the threshold, with the columns ``keep`` of both sides."""
    side = lambda t, n: t.select(F.col("rep").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "sketch", *keep)])
    met = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b")
    odd = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return met.filter(sizes_allow(F.col("size_a"), F.col("size_b"), like) & (odd <= like.most_odd)).select("a", "b", *[f"{c}_{n}" for c in keep for n in ("a", "b")])


def _jaccard_batches(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                va, oa, na = _fingerprints(part.column("text_a"), like.shingle)
                vb, ob, nb = _fingerprints(part.column("text_b"), like.shingle)
                value, owner = np.concatenate((va, vb)), np.concatenate((oa, ob))
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                twice = owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])]
                shared = np.bincount(twice, minlength=len(na))
                alike = shared / (na + nb - shared)
                keep = pa.array(alike >= like.threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(alike).filter(keep)], names=["a", "b", "jaccard"])

    return run


def ranked(pairs: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, jaccard`` of the pairs ``a, b, text_a, text_b`` that reach the threshold over their whole texts."""
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_jaccard_batches(like), "a long, b long, jaccard double")


def exact(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, jaccard`` of the stored pairs that reach the threshold over their whole texts (``rep, text``)."""
    held = wanted(pairs, texts.select("rep", "text"), "a", "b")
    side = lambda n: held.select(F.col("rep").alias(n), F.col("text").alias(f"text_{n}"))
    return ranked(pairs.join(side("a"), "a").join(side("b"), "b"), like)


@dataclass(frozen=True)
class NearDuplicates:
    """``links``: ``a, b, jaccard`` between class representatives. ``copies``: ``id, rep`` of the rows in classes of several."""

    links: DataFrame
    copies: DataFrame


def near_duplicates(rows: DataFrame, like: Likeness) -> NearDuplicates:
    """All pairs of different texts at or above the threshold among ``rows`` (``id`` long, unique, ``text`` as made by ``plain_text``).

    Links hold between representatives (smallest id) of equal texts; ``copies`` gives the members. Null texts take no part, an empty table gives no links,
    texts shorter than a run count as one run, ties do not arise (every pair is kept). Extra columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), "text")
    signed = stored(signatures(rows, like), scratch_path(spark, "signatures"))
    copies = stored(copies_of(signed), scratch_path(spark, "copies"))
    met = candidates(representatives(signed, copies), rows_of(signed), like)
    met = stored(screened(met, signed, signed, like), scratch_path(spark, "candidates"))
    return NearDuplicates(exact(met, signed, like), copies)


def classes(rows: DataFrame, found: NearDuplicates) -> DataFrame:
    """``id, rep, links``: each row that has a text, the representative of its class (equal texts) and the number of other classes this is linked to."""
    ends = found.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    named = rows.filter(F.col("text").isNotNull()).select("id").join(found.copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return named.join(ends, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def expand_pairs(links: DataFrame, copies: DataFrame) -> DataFrame:
    """Every pair of ids ``id_a < id_b``: copies of one text, and copies of linked texts. Only for results that ask for all pairs."""
    link = links.select("a", "b")
    for side in ("a", "b"):
        link = link.join(copies.select(F.col("rep").alias(side), F.col("id").alias(f"copy_{side}")), side, "left")
    crossed = link.select(F.coalesce("copy_a", "a").alias("x"), F.coalesce("copy_b", "b").alias("y"))
    within = copies.alias("l").join(copies.alias("r"), F.col("l.rep") == F.col("r.rep")).filter(F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    return crossed.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
