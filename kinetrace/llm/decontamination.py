"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over SPAN successive words that looks at some positions
and ignores the others, so that a hit survives substituted words. The seeds of
all benchmark items and those of the documents are joined on their hash. A hit
fixes an item and a diagonal (position in the document minus position in the
item); around it the words are compared one by one. An overlap is verified if a
stretch of min(WINDOW, words of the item) aligned words has at least SHARE equal.

Documents are mapped once: a bitmap of fixed size over the benchmark's hashes
drops seeds that cannot join, successive hits become one segment with WINDOW
words to either side, and only segments are shuffled. Joins are by hash, segment
and item, all of them equi-joins; neither side is collected or broadcast by hand.

The masks hit every placement of the substitutions that SHARE allows, in items and
windows of any length from SPAN words on.

Words are runs of letters, digits and non-ASCII characters, A-Z and À-Þ in lower case.
Items of fewer than SPAN words are sought as they stand, whole; those with fewer
than MIN_WORDS words are no evidence and match nothing.

Edge cases: null and empty texts match nothing. Rows with a null item_id are
items too (reported with null). Repeated document rows give one result; rows
with one doc_id and different texts are looked at each, and reported together in
overlaps(), apart in clean(). Empty tables on either side give no overlaps.
Other columns are ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields, saved
from kinetrace.llm.words import PUNCTUATION, mix, slices, word_hashes

MASKS = ((0, 1, 2, 4, 7, 9), (0, 2, 3, 6, 8, 10), (0, 1, 4, 5, 6, 10), (0, 3, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5), (0, 1, 2, 5, 6, 7))
SPAN = 11
WINDOW, SHARE, MIN_WORDS = 20, 0.8, 5
#: Bits of the bitmap of seeds for each seed, and their least and most number (as powers of two; 1 to 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 23, 28
#: Rows to remove up to which their keys are broadcast.
BROADCAST_ROWS = 1 << 20
_U = np.uint64
_ODD = mix(np.arange(1, 1 + SPAN, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)


def _masks(short: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """(words needed, positions looked at): the spaced seeds, then whole items of the given lengths."""
    return [(max(m) + 1, m) for m in MASKS] + [(n, tuple(range(n))) for n in short]


def _seeds(words: np.ndarray, no: int, width: int, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask at each position where it fits."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, _U((no + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for i, at in enumerate(mask):
        out += words[at : at + n] * _ODD[i]
    return mix(out)


def _item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words) and their seeds (hash, item, place)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b["text"]):
                words, _, _, first = word_hashes(data, offsets, PUNCTUATION, latin=True)
                parts = [words[first[i] : first[i + 1]] for i in range(hi - lo)]
                rows = [(i, w) for i, w in enumerate(parts) if len(w) >= MIN_WORDS]
                yield pa.RecordBatch.from_arrays([b["item_id"].take(pa.array([lo + i for i, _ in rows], pa.int64())), pa.array([w.tobytes() for _, w in rows], pa.binary())], names=["item_id", "words"])

    schema = fields(benchmark.select("item_id"), "words binary")
    items = benchmark.select("item_id", "text").mapInArrow(read, schema).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words"))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, item, place = [], [], []
            for key, raw in zip(b["item"].to_pylist(), b["words"].to_pylist(), strict=True):
                words = np.frombuffer(raw, _U)
                fits = _masks((len(words),) if len(words) < SPAN else ())
                for no, (width, mask) in enumerate(fits):
                    if no < len(MASKS) and len(words) < SPAN:
                        continue
                    h = _seeds(words, no if no < len(MASKS) else 100 + width, width, mask)
                    hashes.append(h)
                    item.append(np.full(len(h), key))
                    place.append(np.arange(len(h), dtype=np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(item)), pa.array(np.concatenate(place))], names=["hash", "item", "place"])

    return items, items.select("item", "words").mapInArrow(seed, "hash long, item long, place int")


def _bit(hashes: np.ndarray, no: int, bits: int) -> np.ndarray:
    return ((hashes >> _U(no * bits)) & _U((1 << bits) - 1)).astype(np.int64)


def _has(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def segments(docs: DataFrame, seeds: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """Stretches of documents with seeds that the benchmark may have: doc_id, row, segment, start, words, hits (hash, place)."""
    spark = bounded_batches(docs).sparkSession

    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * seeds.count() - 1).bit_length()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the bitmap that are not 0, from the seeds of a task."""
        table = np.zeros(1 << (size - 3), np.uint8)
        for b in batches:
            h = b["hash"].to_numpy().view(_U)
            for no in (0, 1):
                at = _bit(h, no, size)
                np.bitwise_or.at(table, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].astype(np.int32))], names=["at", "byte"])

    table = np.zeros(1 << (size - 3), np.uint8)  # a row for each of its bytes at most, whatever the benchmark's size
    found = seeds.select("hash").mapInArrow(packed, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    table[found["at"].to_numpy()] = found["byte"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    fits = _masks(short)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for lo, _, data, offsets in slices(b["text"]):
                words, _, _, first = word_hashes(data, offsets, PUNCTUATION, latin=True)
                found = []
                for no, (width, mask) in enumerate(fits):
                    h = _seeds(words, no if no < len(MASKS) else 100 + width, width, mask)
                    at = np.flatnonzero(_has(known, _bit(h, 0, size)))
                    at = at[_has(known, _bit(h[at], 1, size))]
                    doc = np.searchsorted(first, at, "right") - 1
                    whole = at + width <= first[doc + 1]
                    found.append((at[whole], doc[whole], h[at[whole]]))
                at = np.concatenate([x[0] for x in found])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, doc = at[order], np.concatenate([x[1] for x in found])[order]
                hashes = np.concatenate([x[2] for x in found])[order]
                cuts = np.flatnonzero((np.diff(doc) > 0) | (np.diff(at) > WINDOW)) + 1
                rows, start, raw, spots, values = [], [], [], [], []
                for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True):
                    d = doc[a]
                    left = max(first[d], at[a] - WINDOW)
                    right = min(first[d + 1], at[z - 1] + SPAN + WINDOW)
                    rows.append(lo + int(d))
                    start.append(int(left - first[d]))
                    raw.append(words[left:right].tobytes())
                    spots.append((at[a:z] - first[d]).astype(np.int32))
                    values.append(hashes[a:z].view(np.int64))
                sizes = pa.array(np.r_[0, np.cumsum([len(x) for x in spots])].astype(np.int32))
                hits = pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([pa.array(np.concatenate(values)), pa.array(np.concatenate(spots))], names=["hash", "place"]))
                took = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(took), b["row"].take(took), pa.array(start, pa.int32()), pa.array(raw, pa.binary()), hits], names=["doc_id", "row", "start", "words", "hits"])

    rows = docs.select("doc_id", row_key().alias("row"), "text")
    schema = fields(rows.select("doc_id", "row"), "start int, words binary, hits array<struct<hash:long,place:int>>")
    return rows.mapInArrow(read, schema).withColumn("segment", F.xxhash64("row", "start"))


def row_key():
    """What tells rows apart by their own values."""
    return F.xxhash64("doc_id", F.col("text").isNull(), "text")


def row_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, word_start, n_words, n_equal): verified stretches, the longest for each row and item."""
    items, seeds = _item_tables(benchmark)
    items, seeds = saved(items, "items"), saved(seeds, "seeds")
    lengths = items.where(F.length("words") < 8 * SPAN).select((F.length("words") / 8).cast("int").alias("n")).distinct().collect()  # under SPAN rows
    parts = saved(segments(docs, seeds, tuple(sorted(r.n for r in lengths))), "segments")
    hits = parts.select("segment", F.explode("hits").alias("h")).select("segment", "h.hash", F.col("h.place").alias("spot"))
    pairs = hits.join(seeds, "hash").select("segment", "item", (F.col("spot") - F.col("place")).alias("diagonal")).distinct()
    both = pairs.join(parts.drop("hits").dropDuplicates(["segment"]), "segment").join(items.withColumnRenamed("words", "item_words"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, begin, size, same = [], [], [], []
            for i, (mine, theirs, start, diagonal) in enumerate(zip(b["words"], b["item_words"], b["start"].to_pylist(), b["diagonal"].to_pylist(), strict=True)):
                d, t = np.frombuffer(mine.as_buffer(), _U), np.frombuffer(theirs.as_buffer(), _U)
                shift = diagonal - start  # of the item's first word in the segment
                a, z = max(0, -shift), min(len(t), len(d) - shift)
                n = min(WINDOW, len(t))
                if z - a < n:
                    continue
                equal = np.cumsum(np.r_[0, d[a + shift : z + shift] == t[a:z]])
                good = np.flatnonzero(equal[n:] - equal[:-n] >= SHARE * n - 1e-9)
                if len(good):
                    x, y = int(good[0]), int(good[-1]) + n
                    keep.append(i)
                    begin.append(start + shift + a + x)
                    size.append(y - x)
                    same.append(int(equal[y] - equal[x]))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["row"].take(at), b["item_id"].take(at), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.int64())], names=["doc_id", "row", "item_id", "word_start", "n_words", "n_equal"])

    kind = fields(both.select("doc_id", "row", "item_id"), "word_start long, n_words long, n_equal long")
    found = both.select("doc_id", "row", "item_id", "start", "words", "item_words", "diagonal").mapInArrow(verify, kind)
    best = F.max_by(F.struct("word_start", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("word_start"))).alias("b")
    return found.groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", "b.*")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, n_equal): each document that holds an item, its longest verified stretch."""
    best = F.max_by(F.struct("word_start", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("word_start"))).alias("b")
    return row_overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap; no text is shuffled unless more than BROADCAST_ROWS rows go."""
    bad = saved(row_overlaps(docs, benchmark).select(F.col("row").alias("__bad")).distinct(), "bad")
    few = F.broadcast if bad.count() <= BROADCAST_ROWS else lambda df: df
    return docs.join(few(bad), row_key() == F.col("__bad"), "left_anti")
