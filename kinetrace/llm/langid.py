"""Language identification by bit-sliced Bloom filters over byte n-grams.

One filter of SLOTS words holds all languages: bit l of a word belongs to
language l, so that the AND of an n-gram's words gives, in one look-up, the
bitmask of all languages that contain it. A text's popcount per language counts
its n-grams found there. With fill f and K look-ups, f**K of the n-grams that a
language lacks are found by chance; the count is corrected for it, and the
language with the largest corrected share wins. That share is the score.

An n-gram is N successive bytes of the text, A-Z in lower case, all ASCII
non-letters as one boundary byte; n-grams that hold two successive boundaries
are left out, and the text's ends are boundaries. A language contains an n-gram
that is at least SHARE times as frequent there as in the language where it is
most frequent, and was seen MIN_COUNT times.

Learning uses about FIT_ROWS labelled rows, drawn by hash, and of each language
about FIT_EACH at least, or all it has: a rare one is learnt too. The filter has SLOTS
entries whatever the input. Scoring is one map over whole texts.

Edge cases: a text that is null or has no letter is `und` with score 0; one with
letters but no n-gram gets the language with the most learnt rows and score 0;
with nothing learnt all is `und`. Ties go to the language with more learnt rows,
then by name. Rows with null lang or null id are not learnt from. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields
from kinetrace.llm.words import mix, slices

N, K, SLOT_BITS = 4, 3, 20
SHARE, MIN_COUNT, FIT_ROWS, FIT_EACH = 0.3, 2, 4000, 200
_BREAK = 0x20
_FOLD = np.full(256, _BREAK, np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as 32-bit values, and the index of each text's first (and the end)."""
    size = np.diff(offsets)
    width = len(data) + 2 * len(size)
    folded = np.full(width, _BREAK, np.uint8)
    begin = offsets[:-1] + 2 * np.arange(len(size))
    keep = np.ones(width, bool)
    keep[begin] = False
    keep[begin + size + 1] = False
    folded[keep] = _FOLD[data]
    gram = folded.astype(np.uint32)
    broken = folded == _BREAK
    double = np.zeros(width, bool)
    double[:-1] = broken[:-1] & broken[1:]
    m = max(0, width - N + 1)
    value, bad = np.zeros(m, np.uint32), np.zeros(m, bool)
    for i in range(N):
        value |= gram[i : i + m] << np.uint32(8 * i)
        if i < N - 1:
            bad |= double[i : i + m]
    spots = np.flatnonzero(~bad)
    return value[spots], np.searchsorted(spots, np.append(begin, width))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0xA5A5))
    return [((h >> np.uint64(SLOT_BITS * i)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for i in range(K)]


class LanguageFilter:
    def __init__(self, langs: list[str], rows: list[int], slots: np.ndarray, masks: np.ndarray):
        """langs with their learnt rows, most first; slots with the bits set there, one column of 64 languages each."""
        self.langs, self.rows = langs, rows
        self.words = np.zeros((masks.shape[1], 1 << SLOT_BITS), np.uint64)
        for w in range(masks.shape[1]):
            np.bitwise_or.at(self.words[w], slots, masks[:, w])
        small = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= 8 * t().itemsize or t is np.uint64)
        self.words = self.words.astype(small) if len(langs) <= 64 else self.words
        fill = [float(((self.words[i // 64] >> small(i % 64)) & small(1)).mean()) for i in range(len(langs))]
        self.chance = np.array(fill) ** K

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index (-1: no n-gram) and score of each text."""
        grams, first = ngrams(data, offsets)
        n = np.diff(first).astype(float)
        at = _slots(grams)
        found = np.empty((len(self.langs), len(n)))
        for w, word in enumerate(self.words):
            mask = word[at[0]]
            for a in at[1:]:
                mask &= word[a]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                total = np.zeros(len(grams) + 1, np.int32)
                np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), out=total[1:])
                found[i] = total[first[1:]] - total[first[:-1]]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.clip((found / n - self.chance[:, None]) / (1 - self.chance[:, None]), 0, 1)
        best = np.where(n > 0, np.argmax(np.nan_to_num(share), axis=0), -1)
        return best, np.where(n > 0, np.nan_to_num(share).max(axis=0), 0.0)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_each: int = FIT_EACH) -> LanguageFilter | None:
    """A filter learnt from (doc_id, text, lang); None if no row has text and lang."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    had = usable.groupBy("lang").count().collect()  # a row for each language
    if not had:
        return None
    total = sum(r["count"] for r in had)
    bounds = [(r.lang, int((1 << 40) * min(1.0, max(fit_rows / total, fit_each / r["count"])))) for r in had]
    shares = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 40))
    sample = usable.join(F.broadcast(shares), "lang").where(draw < F.col("bound")) if total > fit_rows else usable
    langs = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not langs:
        return None
    order = sorted(langs, key=lambda x: (-langs[x], x))
    number = {x: i for i, x in enumerate(order)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([number[x] for x in b["lang"].to_pylist()], np.int64)
            for lo, hi, data, offsets in slices(b["text"]):
                grams, first = ngrams(data, offsets)
                lang = np.repeat(codes[lo:hi], np.diff(first))
                key, n = np.unique((lang << 32) | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["l", "gram", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "l long, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "l").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    held = rates.join(top, "gram").where((F.col("rate") >= SHARE * F.col("top")) & (F.col("n") >= MIN_COUNT))
    columns = (len(order) + 63) // 64
    bits = [F.expr(f"coalesce(bit_or(CASE WHEN l div 64 = {w} THEN shiftleft(1L, cast(l % 64 AS INT)) END), 0L) AS m{w}") for w in range(columns)]

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_slots(b["gram"].to_numpy().astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *[pa.array(np.tile(b[f"m{w}"].to_numpy(), K)) for w in range(columns)]], names=["slot", *[f"m{w}" for w in range(columns)]])

    per_gram = held.groupBy("gram").agg(*bits)
    names = [f"m{w}" for w in range(columns)]
    schema = ", ".join(["slot long", *[f"{m} long" for m in names]])
    filled = per_gram.mapInArrow(to_slots, schema).groupBy("slot").agg(*[F.bit_or(m).alias(m) for m in names]).toArrow()  # SLOTS rows at most
    masks = np.stack([filled[m].to_numpy() for m in names], axis=1).view(np.uint64)
    return LanguageFilter(order, [langs[x] for x in order], filled["slot"].to_numpy(), masks)


def _no_letter(text: str | None) -> bool:
    return text is None or not any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: LanguageFilter | None, keys: list[str]) -> DataFrame:
    """keys of docs, lang_pred and score; only text is looked at."""
    spark = bounded_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b["text"]
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for lo, hi, data, offsets in slices(texts):
                if m is None:
                    best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                else:
                    best, score = m.score(data, offsets)
                ascii_letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_LETTER[data], out=ascii_letters[1:])
                plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in range(hi - lo):
                    if m is None or not plain[i] and _no_letter(texts[lo + i].as_py()):
                        score[i] = 0.0
                        langs.append("und")
                    else:
                        langs.append(m.langs[max(0, best[i])])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keys, "lang_pred", "score"])

    rows = docs.select(*keys, "text")
    return rows.mapInArrow(predict, fields(rows.select(*keys), "lang_pred string, score double"))
