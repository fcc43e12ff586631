"""Document fingerprints by spot signatures.

A spot signature is an anchor with the chain of the next CHAIN content words that
follow it; its hash is kept in 32 bits. Anchors are common words, every word whose
hash falls in one of EVERY classes, and the text's start; all other words are content.
A fingerprint is the set of a text's signatures, as sorted hex words. Prose has many
anchors, lists and boilerplate few, so that what counts is running text; the rule is
the same for texts of any length. The likeness of two fingerprints is the
Jaccard index of their sets.

near_duplicates() compares fingerprints in the way of jaccard.py: common signatures come last
in the order of prefixes, those of one set alone are put aside, and sets that cannot reach the
threshold any more go. Sets are set against each other only if they share as many of their first
signatures as any link of theirs needs and if lengths and places allow the threshold, first with the
set that stands for a posting, then in blocks (see jaccard.links_of()); a comparison of two sets stops
where the threshold is out of reach. Copies and pairs within a group are never
written out: the result is a class for each fingerprint.

fingerprint_edits() needs each text's follower. Texts are dealt into ranges of about
RANGE_BYTES in the order of their ids, each its own task, with the first row of the next range as a
guest; each text is shuffled once. The bounds come from about BOUND_ROWS rows, and EACH_RANGE for each range, drawn by hash.

Words are runs of letters, digits and non-ASCII characters, A-Z and À-Þ in lower case.

Edge cases: null counts as an empty text; a text without words has an empty
fingerprint, like only to another empty one (likeness 1). In the descending
order null ids come last, equal ids by the first HEAD characters of their texts; after the last row comes the first.
A table of one row follows itself. Other columns are kept or ignored as stated.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.jaccard import components, frequent, links_of_picked, may_meet, postings, shared_bitmap
from kinetrace.llm.store import bounded_batches, fields, hot_keys, saved, spread_join
from kinetrace.llm.words import PUNCTUATION, mix, slices, word_hashes

# Common words of six languages.
ANCHORS = tuple(
    """a an and are as at be by for from had has have he in is it not of on or that the there this to was were which with
    au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se sur un une
    auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu
    al como con de del el en es esta la las lo los más no para pero por que se su sus un una y
    che da del della di e gli il in la le nel non per si sono un una
    com da das do dos e em na não no o os para por que se um uma""".split()
)
CHAIN, EVERY = 2, 16
RANGE_BYTES, MOST_RANGES, BOUND_ROWS, EACH_RANGE, HEAD = 16 << 20, 1 << 16, 20_000, 16, 32
_U = np.uint64
_STEP = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(data, offsets, PUNCTUATION, latin=True)[0] for _, _, data, offsets in slices(pa.array(words))]))


_ANCHOR_SET = _hash_words(ANCHORS)
_TABLE = np.zeros(1 << 16, bool)
_TABLE[(_ANCHOR_SET >> _U(48)).astype(np.int64)] = True


def _is_anchor(words: np.ndarray) -> np.ndarray:
    out = _TABLE[(words >> _U(48)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(_ANCHOR_SET, words[maybe])
    out[maybe] = _ANCHOR_SET[np.minimum(at, len(_ANCHOR_SET) - 1)] == words[maybe]
    return out | (words % _U(EVERY) == 0)


def _signatures(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    texts = len(first) - 1
    anchor = _is_anchor(words)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    doc = np.searchsorted(first, spots, "right") - 1
    nth = np.searchsorted(content, spots)
    values = words[spots] * _STEP[0]
    inside = nth + CHAIN <= len(content)
    for i in range(CHAIN):
        at = content[np.minimum(nth + i, max(0, len(content) - 1))] if len(content) else np.zeros(len(spots), np.int64)
        values = mix(values + words[at] * _STEP[1 + i % 2])
        inside &= at < first[doc + 1]
    values, doc = (mix(values) >> _U(32)).astype(np.uint32)[inside], doc[inside]
    # each text's start, with the words that follow it, whatever they are
    some = np.flatnonzero(np.diff(first) > 0)
    starts = np.full(len(some), _U(0x51ED270B))
    for i in range(CHAIN + 1):
        at = first[some] + i
        here = at < first[some + 1]
        starts = np.where(here, mix(starts + words[np.minimum(at, max(0, len(words) - 1))] * _STEP[i % 3]), starts)
    values, doc = np.concatenate([values, (mix(starts) >> _U(32)).astype(np.uint32)]), np.concatenate([doc, some])
    order = np.argsort(doc, kind="stable")
    values, ends = values[order], np.searchsorted(doc[order], np.arange(texts + 1))
    return [np.unique(values[ends[i] : ends[i + 1]]) for i in range(texts)]


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """The signature set of each text of a string array."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in slices(texts):
        words, _, _, first = word_hashes(data, offsets, PUNCTUATION, latin=True)
        out += _signatures(words, first)
    return out


def shown(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(a) + len(b) - same)


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, range_bytes: int) -> DataFrame | None:
    """(doc_id, text, range, guest) in runs of descending doc_id, a guest behind each run; None for an empty table.

    Rows are ordered by a key of their id and the head of the text, so only rows that
    agree in both are kept in one range. Ranges are parted by keys that occur:
    a range's first row is dealt to the one before it as well, and the very first row to the last range.
    """
    rows = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0).cast("long"))
    key = F.struct(F.col("doc_id").isNull().alias("a"), number.alias("b"), F.substring("text", 1, HEAD).alias("c"))
    keyed = rows.withColumn("key", key)
    narrow = keyed.select("key", F.octet_length("text").cast("long").alias("bytes"))
    total = narrow.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("key").alias("first")).first()
    if not total.n:
        return None
    ranges = int(min(MOST_RANGES, max(1, -(-total.bytes // range_bytes))))
    bounds: list[tuple] = []
    if ranges > 1:
        most = BOUND_ROWS + EACH_RANGE * ranges
        drawn = narrow if total.n <= most else narrow.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 40)) < int((1 << 40) * most / total.n))
        seen = sorted((tuple(r.key), r.bytes) for r in drawn.collect())  # most rows or so
        upto = np.cumsum([0, *[n for _, n in seen]])
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges))
        bounds = sorted({seen[min(int(i), len(seen) - 1)][0] for i in at} - {tuple(total.first)})
    kind = "struct<a:boolean,b:bigint,c:string>"
    lit = lambda k: F.struct(F.lit(k[0]).alias("a"), F.lit(k[1]).cast("long").alias("b"), F.lit(k[2]).alias("c")).cast(kind)
    # of several hundred bounds, first the block, then the place in it
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda items: F.size(F.filter(F.array(*[lit(k) for k in items]).cast(f"array<{kind}>"), lambda x: x <= F.col("key")))
    if len(blocks) <= 1:
        low = below(bounds) if bounds else F.lit(0)
    else:
        block = below([b[0] for b in blocks])
        table = F.array(*[F.array(*[lit(k) for k in b[1:]]).cast(f"array<{kind}>") for b in blocks])
        inside = F.size(F.filter(F.get(table, F.greatest(block - 1, F.lit(0))), lambda x: x <= F.col("key")))
        low = F.when(block == 0, 0).otherwise((block - 1) * width + 1 + inside)
    placed = keyed.withColumn("range", low.cast("int"))
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    is_first = F.col("key").isin(*[lit(k) for k in bounds]) if len(bounds) <= 64 else F.array_contains(F.array(*[lit(k) for k in bounds]), F.col("key"))
    ahead = F.when(is_first, F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))) if bounds else F.lit(None).cast("struct<range:int,guest:int>")
    wrap = F.when(F.col("key") == lit(tuple(total.first)), F.struct(F.lit(len(bounds)).alias("range"), F.lit(1).alias("guest")))
    dealt = placed.select("doc_id", "text", "key", F.explode(F.array_compact(F.array(own, ahead, wrap))).alias("d")).select("doc_id", "text", "key", "d.range", "d.guest")
    return dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("guest", "key", "text").select("doc_id", "text", "range", "guest")


def _pairs(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[tuple[list[int | None], list[str], list[str]]]:
    """Ids, texts and next texts of dealt rows, about size characters at a time."""
    held = None  # range, id and text whose follower has not come yet
    ids, texts, nexts, had = [], [], [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            for k, doc, text, guest in zip(*(part[c].to_pylist() for c in ("range", "doc_id", "text", "guest")), strict=True):
                if held is not None and held[0] == k:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(text)
                    had += len(held[2])
                held = None if guest else (k, doc, text)
                if had > size:
                    yield ids, texts, nexts
                    ids, texts, nexts, had = [], [], [], 0
    if ids:
        yield ids, texts, nexts


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, next_text) in descending order of doc_id, where the first follows the last."""
    dealt = _dealt(docs, range_bytes)
    schema = "doc_id long, text string, next_text string"
    if dealt is None:
        return docs.sparkSession.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], names=["doc_id", "text", "next_text"])

    return dealt.mapInArrow(read, schema)


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    dealt = _dealt(docs, range_bytes)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if dealt is None:
        return docs.sparkSession.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _pairs(batches):
            edited = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
            own, new = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(edited, pa.large_string()))
            chain = [i + 1 if i + 1 < len(texts) and nexts[i] is texts[i + 1] else -1 for i in range(len(texts))]
            alone = [i for i, f in enumerate(chain) if f < 0]
            extra = dict(zip(alone, fingerprints(pa.array([nexts[i] for i in alone], pa.large_string())), strict=True))
            after = [own[f] if f >= 0 else extra[i] for i, f in enumerate(chain)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([shown(x) for x in own]),
                    pa.array([shown(x) for x in new]),
                    pa.array([likeness(x, y) for x, y in zip(own, new, strict=True)]),
                    pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(read, schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs with fingerprint and n_signatures."""
    docs = bounded_batches(docs).drop("fingerprint", "n_signatures")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = fingerprints(b["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shown(x) for x in sets], pa.string()), pa.array([len(x) for x in sets], pa.int64())], names=[*b.schema.names, "fingerprint", "n_signatures"])

    return docs.mapInArrow(read, fields(docs, "fingerprint string, n_signatures long"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with fingerprint, n_signatures and class_id: the smallest doc_id reachable by fingerprints whose likeness is threshold or more.

    A document with an empty fingerprint is in a class with the others of that kind, as is any group of
    equal fingerprints. Links between different fingerprints are found by links_between().
    """
    rows = saved(fingerprint_documents(docs).withColumn("__cls", F.xxhash64("fingerprint")), "fingerprints")
    links = links_between(rows.select("fingerprint", "n_signatures"), threshold)
    groups = components(links).withColumnRenamed("node", "__cls")
    hot = hot_keys(groups, "component")
    classes = rows.groupBy("__cls").agg(F.min("doc_id").alias("__doc")).join(groups, "__cls", "left").withColumn("component", F.coalesce("component", "__cls"))
    least = classes.groupBy("component").agg(F.min("__doc").alias("class_id"))
    of_class = spread_join(classes.select("__cls", "component"), least, "component", hot).select("__cls", "class_id")
    found = spread_join(rows, of_class, "__cls", hot_keys(rows, "__cls"), "left")
    return found.select(*[f"`{c}`" for c in rows.columns if c != "__cls"], "class_id")


def _tokens(fingerprint: str) -> np.ndarray:
    """Sorted signatures as 64-bit tokens: each in the leading bits, which comparisons carry whole, its mixed bits behind."""
    own = np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(_U)
    return own << _U(32) | mix(own) >> _U(32)


def _held(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(raw.as_buffer(), _U) for raw in batch["tokens"])


def links_between(prints: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of hashed fingerprints that join all whose likeness is threshold or more, directly or in steps.

    Signatures are counted first: in the order of their number, a set's first ones are
    rare, and few sets meet in them. Only sets that meet others there go on.
    """
    percent = round(100 * threshold)
    one = prints.where("n_signatures > 0").select("fingerprint", F.col("n_signatures").alias("n")).dropDuplicates(["fingerprint"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["cls"], b["n"], pa.array([_tokens(x).tobytes() for x in b["fingerprint"].to_pylist()], pa.binary())], names=["cls", "n", "tokens"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([may_meet(tokens, order.value, shared.value, percent) for tokens in _held(b)], pa.bool_()))

    kind = "cls long, n long, tokens binary"
    sets = saved(one.select(F.xxhash64("fingerprint").alias("cls"), "n", "fingerprint").mapInArrow(read, kind), "spots")
    share = sets.sparkSession.sparkContext.broadcast
    order = share(frequent(sets.select("tokens"), _held))
    shared = share(shared_bitmap(postings(sets.select("tokens"), _held, order, percent)))
    return links_of_picked(saved(sets.mapInArrow(pick, kind), "picked"), order, percent)
