"""Importance resampling towards a target: hashed n-gram features, log ratios, Gumbel top-k.

Features of a text are its runs of one to ORDER words. Each falls in a bucket,
the CRC-32 of its bytes modulo BUCKETS; a bucket's gain is the logarithm of how
much more frequent it is in the target than in the documents (smoothed), and a
document's weight the mean gain of its features. Adding Gumbel noise drawn from
the id and taking the highest scores draws documents without replacement in
proportion to exp(weight).

Words are put in an integer dictionary: the distinct words of a slice of texts
(words.slices(), or one longer text) get ids in the order of their hashes. An n-gram
is the tuple of its words' ids, kept as one integer: the id of the run without its last word, times
the number of words, plus the last word's id. Distinct tuples are found by sorting integers; the bytes
of each are put together from the words once and hashed once, and the buckets
are joined back to all occurrences by the tuple's place. The dictionary's scope
is a slice so that no feature of any document is shuffled: what leaves a task is a
count per bucket, and of a document its number of features and its sum of gains.

Three steps: one map over documents and target counts buckets (BUCKETS rows of
each task are added up); a second map over the documents sums their gains; the
slim rows (ids and scores) are ordered by ranges, and a range's first rank is the
number of rows in the ranges before it. No window spans the table.

Edge cases: a null or empty text has no features, weight 0, and is never drawn
(fewer than LEAST_WORDS words). A null doc_id draws by an id without digits and comes
first among ties. Repeated rows are rows: equal ids share a score. An empty target
or table counts as no features. Other columns are ignored. Counts and ratios are doubles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, saved
from kinetrace.llm.words import PUNCTUATION, slices, word_hashes

BUCKETS, ORDER, LEAST_WORDS, PERCENT = 10_000, 2, 20, 25
SLICE_BYTES = 4 << 20


def _lower(word: bytes) -> bytes:
    return word.lower()  # of bytes: A-Z only


def features(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each feature of a slice of texts, given by its bytes and where each text begins; and each text's number of words."""
    hashes, starts, ends, first = word_hashes(data, offsets, PUNCTUATION)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(first)
    _, example, ids = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [_lower(raw[a:b]) for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's text, in words
    tuples, grams, found, of = ids.astype(np.int64), words, [], []
    for k in range(1, order + 1):
        at = np.flatnonzero(np.arange(n) + k <= last)
        if k > 1:
            pairs = tuples[at] * len(words) + ids[at + k - 1]
            distinct, places = np.unique(pairs, return_inverse=True)
            grams = [grams[a] + b" " + words[b] for a, b in zip((distinct // len(words)).tolist(), (distinct % len(words)).tolist(), strict=True)]
            tuples = np.full(n, -1, np.int64)
            tuples[at] = places
        hashed = np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % buckets
        found.append(hashed[tuples[at]])
        of.append(text[at])
    return np.concatenate(found), np.concatenate(of), np.diff(first)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of the column text fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE_BYTES):
                total += np.bincount(features(data, offsets, order, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return bounded_batches(texts.select("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, 1000 times the log ratio of its smoothed shares in target and docs, rounded down: one row per bucket reaches the driver."""
    both = bucket_counts(docs, order, buckets).withColumn("which", F.lit(0)).union(bucket_counts(target, order, buckets).withColumn("which", F.lit(1)))
    counts = np.zeros((2, buckets))
    for bucket, n, which in both.collect():
        counts[which, bucket] = n
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight: the mean gain of the features, rounded down (0 without any)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            n, total = np.zeros((2, batch.num_rows), np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in slices(batch.column(1), SLICE_BYTES):
                found, of, n[0, lo:hi] = features(data, offsets, order, len(table))
                n[1, lo:hi] = np.bincount(of, minlength=hi - lo)
                total[lo:hi] = np.bincount(of, table[found], minlength=hi - lo)  # whole numbers, exact in doubles
            weight = np.where(n[1] > 0, total // np.maximum(n[1], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (*n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(read, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; rank is null unless drawn.

    Drawn are percent of the documents of at least least_words words, those of the highest scores; ties go to the smaller doc_id.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    # stored, as ranges are found by a look at the rows before they are dealt
    scored = saved(weighed(docs, gains(docs, target, order, buckets), order).withColumn("score", F.col("weight") + noise), "scored")
    ordered = scored.withColumn("__open", F.col("n_words") >= least_words)
    keys = [F.col("__open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are written, so that their order and sizes are those of one run
    ranged = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    rows = saved(ranged.withColumn("__place", place), "ranged")
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = rows.where("__open").groupBy(part.alias("__part")).count().orderBy("__part").collect()  # one row per range
    ends = list(accumulate(n for _, n in sizes))
    before = docs.sparkSession.createDataFrame([(p, end - n) for (p, n), end in zip(sizes, ends, strict=True)], "__part long, __before long")
    rank = F.col("__before") + within + 1
    drawn = F.col("__open") & (rank <= percent * (ends[-1] if ends else 0) // 100)
    rows = rows.withColumn("__part", part).join(F.broadcast(before), "__part", "left")
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
