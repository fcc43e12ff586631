"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A text's set holds its distinct shingles of K words. Two sets link when
100 * intersection >= PERCENT * union. Equal sets are one class; all that
follows works on classes.

Prefixes. In one order of all shingles, two sets that link share at least m
shingles among their first n - ceil(PERCENT * n / 100) + m. Frequent shingles
come last: their counts come from a hashed sketch over all texts. For each set
m is the one with the least estimated cost: a longer prefix has more postings
to read, but only 1/m of them can be candidates that share m. It is half of
the shingles that the set can spare at least, so that a line which many texts
have makes no candidate by itself. Two sets with different m need the smaller one.

1. Count: one map over the texts sums up the sketch.
2. Share: a second map gives each prefix shingle with its class; a grouped min
   and max finds the shingles that two classes share. They are marked in a bitmap
   sized by their number, up to a bound.
3. Pick: a third map keeps the sets of those texts whose prefix for that least m has
   m shared shingles (only they can have a link), with the class of every text.
4. Among these sets shingles that occur once are found in the same way and put
   first in the order: they match nothing, so each shortens what its set can still
   reach, and the sets that cannot reach any link go.
5. Stars: each set has a posting for each shingle of the prefix chosen for it. For each
   shared shingle the sets in its postings are set against the one that has the fewest
   unshared shingles; a pair that meets in as many shingles as the smaller m of the two is
   verified. A large group of near copies falls together here, with one such meeting per set and
   shingle at most.
6. Rest: where the postings of a shingle still lie in two or more groups, the sets
   outside the group of its hub (the set with the fewest unshared shingles) are set
   against all sets near that hub. Within postings of at most LONG sets pairs are joined and
   counted by a grouped sum, and those that share as many prefix shingles as the smaller m are
   verified; through longer ones sets are compared in blocks of bounded size, which count
   in the same way by the postings in the block. Two sets that share no long posting have all
   their shared shingles in short ones, so no count is too low; of any two sets in different groups that share a prefix
   shingle one is outside the hub's group, so no pair that may link is left out.
   A pair is counted only if lengths and places allow a link.
7. Components of all links by smallest labels and pointer jumping.

Keys with many rows (a shingle of many sets, the hub of a large group, a set of many
copies, a large component) are joined in parts, see store.spread_join().

Bitmap hits by chance only let more sets through; no step drops a possible link.
Shingles are 64-bit hashes; comparisons carry 48 bits of each. Classes have two such
hashes: sets that share the first but not the second are told apart.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing; with fewer than K words the whole sequence is one shingle.
Repeated rows fall in one class; a null doc_id is never a component's id unless
no member has one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, hot_keys, saved, spread_join
from kinetrace.llm.words import mix, shingles, slices, word_hashes

SKETCH_BITS = 22
#: Bits of a bitmap for each shingle in it, and the least and most there may be (as powers of two; 8 to 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 26, 28
#: Matches that a prefix may stand for, as shares of the shingles that a set can spare; the first is the least.
MATCHES = (0.5, 0.625, 0.75, 0.875, 1.0)
#: Cost of comparing two sets against reading one posting.
COMPARE = 20.0
#: Sets on either side of a block, and the postings of a shingle up to which its pairs are joined.
BLOCK, LONG = 512, 50
_U = np.uint64


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for lo, hi, data, offsets in slices(column):
        words, _, _, first = word_hashes(data, offsets)
        for i in range(hi - lo):
            yield lo + i, np.unique(shingles(words[first[i] : first[i + 1]], k))


def _packed(tokens: np.ndarray) -> bytes:
    """The first 48 bits of sorted tokens: what comparisons carry about."""
    return (tokens >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: pa.Scalar | bytes) -> np.ndarray:
    six = np.frombuffer(raw if isinstance(raw, bytes) else raw.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(_U).ravel()


def _class(tokens: np.ndarray) -> int:
    total = mix(tokens + _U(0x5DEECE66D)).sum(dtype=_U) + _U(len(tokens))
    return int(mix(np.array([total], _U)).view(np.int64)[0])


def _second(tokens: np.ndarray) -> int:
    """Another hash of a set, from products instead of mixed tokens."""
    total = (tokens * (tokens | _U(1))).sum(dtype=_U) + _U(len(tokens))
    return int(mix(np.array([total], _U)).view(np.int64)[0])


def least_overlap(a: int, percent: int) -> int:
    """Shingles that a set of a must share with a smaller or equal one at least."""
    return -(-percent * a // 100)


def matches(n: int, spare: int, share: float) -> int:
    """Matches of a prefix by share of the spare ones of n shingles; grows with the set."""
    return min(1 + int(spare * share), max(1, n - spare))


def least_prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of a prefix of a set of n, and the matches in it with any set that it links with, whatever m either has."""
    small = least_overlap(n, percent)
    m = matches(small, small - least_overlap(small, percent), MATCHES[0])
    return n - small + m, m


class _Order:
    """Rank of shingles: those known to be frequent last, by their count, the rest by hash."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        order = np.argsort(slots)
        self.slots, self.counts = slots[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits = np.packbits(np.bincount(self.slots, minlength=1 << SKETCH_BITS).astype(bool))

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens))
        if len(self.slots):
            slot = (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)
            known = np.flatnonzero((self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            out[known] = self.counts[np.searchsorted(self.slots, slot[known])]
        return out

    def prefix(self, tokens: np.ndarray, percent: int, unshared: int = 0) -> tuple[np.ndarray, int]:
        """The prefix in order, of tokens that follow as many unshared ones, and the number of matches it stands for."""
        frequent = self.frequency(tokens)
        order = np.argsort(frequent, kind="stable")
        n = len(tokens) + unshared
        spare = n - least_overlap(n, percent) - unshared
        if spare < 0:
            return tokens[:0], 1
        cost = np.cumsum(np.r_[0.0, frequent[order]])
        best, take = np.inf, (spare + 1, 1)
        for m in sorted({matches(len(tokens), spare, share) for share in MATCHES}):
            end = min(spare + m, len(tokens))
            estimate = end + cost[end] * (1 + COMPARE / m)
            if estimate < best:
                best, take = estimate, (end, m)
        return tokens[order[: take[0]]], take[1]


#: The tokens of each set in a batch.
TokensOf = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _of_texts(k: int) -> TokensOf:
    return lambda b: (tokens for _, tokens in _sets(b["text"], k))


def frequent(rows: DataFrame, tokens_of: TokensOf) -> _Order:
    """Slots of the sketch that hold far more than their share, from every set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << SKETCH_BITS, np.int32), 0
        for b in batches:
            held, size = [], 0
            for tokens in tokens_of(b):
                held.append((tokens >> _U(64 - SKETCH_BITS)).astype(np.int64))
                size += len(tokens)
                if size > 1 << 18:
                    np.add.at(total, np.concatenate(held), 1)
                    seen, held, size = seen + size, [], 0
            if held:
                np.add.at(total, np.concatenate(held), 1)
                seen += size
        usual = seen / len(total)
        slots = np.flatnonzero(total > 4 * usual + 8)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((total[slots] - usual).astype(np.int64))], names=["slot", "n"])

    found = rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row per slot at most
    return _Order(found["slot"].to_numpy(), found["n"].to_numpy())


class _Bitmap:
    """Which tokens may be marked: two bits for each, in 2**size."""

    def __init__(self, size: int, packed: np.ndarray):
        self.size, self.packed = size, packed

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), bool)
        for shift in (0, 32):
            bit = ((tokens >> _U(shift)) & _U((1 << self.size) - 1)).astype(np.int64)
            out &= ((self.packed[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def shared_bitmap(rows: DataFrame) -> _Bitmap:
    """From (token, cls): a bitmap of the tokens that two classes have."""
    shared = saved(rows.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("token"), "shared")
    size = min(max(LEAST_BITS, (BITS_EACH * shared.count()).bit_length()), MOST_BITS)
    low = (1 << size) - 1
    bit = shared.select(F.explode(F.array(F.col("token").bitwiseAND(low), F.shiftrightunsigned("token", 32).bitwiseAND(low))).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()  # 2**size bits at most
    out = np.zeros(1 << (size - 3), np.uint8)
    for no, bits in zip(parts["no"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[(no - 1) * 4096 : no * 4096] = np.frombuffer(bits, np.uint8)[: max(0, len(out) - (no - 1) * 4096)]
    return _Bitmap(size, out)


def postings(rows: DataFrame, tokens_of: TokensOf, order: object, percent: int) -> DataFrame:
    """(token, cls) of every prefix."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, cls, size = [], [], 0
            for tokens in tokens_of(b):
                if len(tokens):
                    prefix = order.value.prefix(tokens, percent)[0]
                    held.append(prefix)
                    cls.append(np.full(len(prefix), _class(tokens)))
                    size += len(prefix)
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(cls))], names=["token", "cls"])
                    held, cls, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(cls))], names=["token", "cls"])

    return rows.mapInArrow(read, "token long, cls long")


def may_meet(tokens: np.ndarray, order: _Order, shared: _Bitmap, percent: int) -> bool:
    """Whether a set shares as many tokens of its least prefix as any link of its needs."""
    end, m = least_prefix(len(tokens), percent)
    return len(tokens) > 0 and int(shared(order.prefix(tokens, percent)[0][:end]).sum()) >= m


def _picked(docs: DataFrame, order: object, shared: object, k: int, percent: int) -> DataFrame:
    """doc_id, n, cls and its second hash of each row, and the tokens of the sets that may have a link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, other, raw, done, size = [], [], [], [], 0, 0

            def table(b: pa.RecordBatch = b) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b["doc_id"][done : done + len(n)], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "n", "cls", "other", "tokens"])

            for _, tokens in _sets(b["text"], k):
                keep = may_meet(tokens, order.value, shared.value, percent)
                n.append(len(tokens))
                cls.append(_class(tokens))
                other.append(_second(tokens))
                raw.append(tokens.tobytes() if keep else None)
                size += len(raw[-1] or b"")
                if size > 1 << 23:
                    yield table()
                    done += len(n)
                    n, cls, other, raw, size = [], [], [], [], 0
            if n:
                yield table()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, cls long, other long, tokens binary")


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows in which sets with one first hash and different second ones have classes of their own; of 10**10 sets some three do."""
    seconds = rows.groupBy("cls").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least < most").select("cls", "least")
    seconds = saved(seconds, "seconds")
    if not seconds.limit(1).count():
        return rows.drop("other")
    apart = rows.join(seconds, "cls", "left").withColumn("cls", F.when(F.col("other") != F.col("least"), F.xxhash64("cls", "other")).otherwise(F.col("cls")))
    return saved(apart.drop("other", "least"), "rows")


def marks_of(sets: DataFrame) -> DataFrame:
    """(token, cls) of every set, one of equal sets in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for cls, raw in zip(b["cls"].to_pylist(), b["tokens"], strict=True):
                if cls not in seen:
                    seen.add(cls)
                    tokens = np.frombuffer(raw.as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), cls))], names=["token", "cls"])

    return sets.select("cls", "tokens").mapInArrow(read, "token long, cls long")


def _narrowed(sets: DataFrame, order: object, shared: object, percent: int) -> DataFrame:
    """cls, n, unshared, m, tokens (the shared ones, packed) and prefix of the sets that can reach a link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for cls, n, raw in zip(b["cls"].to_pylist(), b["n"].to_pylist(), b["tokens"], strict=True):
                if cls in seen:
                    continue
                seen.add(cls)
                tokens = np.frombuffer(raw.as_buffer(), _U)
                tokens = tokens[shared.value(tokens)]
                unshared = n - len(tokens)
                prefix, m = order.value.prefix(tokens, percent, unshared)
                if len(prefix) >= m:
                    rows.append((cls, n, unshared, m, _packed(tokens), _packed(prefix)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], names=["cls", "n", "unshared", "m", "tokens", "prefix"])

    return sets.mapInArrow(read, "cls long, n long, unshared long, m long, tokens binary, prefix binary")


def _entries(sets: DataFrame) -> DataFrame:
    """token, cls, n, unshared, m and place of each shingle of the sets' prefixes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [_unpacked(p) for p in b["prefix"]]
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in lists]])
            columns = {c: b[c].to_numpy()[row] for c in ("cls", "n", "unshared", "m")}
            tokens = np.concatenate([np.zeros(0, _U), *lists]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, *columns.values(), at + columns["unshared"])], names=["token", *columns, "place"])

    return sets.select("cls", "n", "unshared", "m", "prefix").mapInArrow(read, "token long, cls long, n long, unshared long, m long, place long")


def _may_link(percent: int) -> Column:
    """Of postings a and b of one token: lengths and places still allow a link."""
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / F.lit(100 + percent) - F.lit(1e-9))
    before = F.least(F.col("a.place") - F.col("a.unshared"), F.col("b.place") - F.col("b.unshared"))
    after = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    lengths = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return lengths & (before + after >= need)


def shares(a: np.ndarray, b: np.ndarray, need: int, step: int = 512) -> bool:
    """Whether two sorted sets share need members at least; stops at the first slice of step members from which they cannot, or when they do."""
    same = i = j = 0
    while i < len(a) and j < len(b) and same < need:
        if same + min(len(a) - i, len(b) - j) < need:
            return False
        top = min(a[min(i + step, len(a)) - 1], b[min(j + step, len(b)) - 1])
        x, y = i + int(np.searchsorted(a[i : i + step], top, "right")), j + int(np.searchsorted(b[j : j + step], top, "right"))
        both = np.concatenate([a[i:x], b[j:y]])
        both.sort()
        same += int((both[1:] == both[:-1]).sum())
        i, j = x, y
    return same >= need


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) of classes that link; hot: the b of many pairs."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y, n_a, n_b) in enumerate(zip(batch["x"], batch["y"], batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), strict=True)):
                if shares(_unpacked(x), _unpacked(y), -(-percent * (n_a + n_b) // (100 + percent))):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return spread_join(pairs.join(left, "a"), right, "b", hot).select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of the links (a, b) the smallest node that it reaches."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    hubs = hot_keys(both, "b")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "component"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = saved(labels.join(near, "node").select("node", F.least("component", "near").alias("new"), F.col("component").alias("old")), "lower")
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("root"))
        found = spread_join(lower, jump, "new", hot_keys(lower, "new"))
        stepped = saved(found.select("node", F.least("new", "root").alias("component"), (F.least("new", "root") != F.col("old")).alias("moved")), "labels")
        labels = stepped.select("node", "component")
        if not stepped.where("moved").limit(1).count():
            return labels


def _shared_counts(owner: np.ndarray, sorted_: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """How many of tokens each of n sets has, from their tokens in order and whose each is."""
    lo, hi = np.searchsorted(sorted_, tokens, "left"), np.searchsorted(sorted_, tokens, "right")
    size = hi - lo
    at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return np.bincount(owner[at], minlength=n)


def _between_groups(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of different groups that are near one hub; near has cls, grp, hub and hub_grp.

    Of two such sets one at least is outside the hub's group. These are compared
    with all that are near the hub, in blocks of at most about BLOCK sets on
    either side, through the postings of the block: first the shared prefix
    shingles are counted, then all.
    """
    sizes = near.groupBy("hub").agg(F.count("*").alias("all"), F.count_if(F.col("grp") != F.col("hub_grp")).alias("out")).where("out > 0")
    blocks = sizes.select("hub", F.ceil(F.col("all") / BLOCK).alias("na"), F.ceil(F.col("out") / BLOCK).alias("no"))
    rows = near.join(blocks, "hub").join(sets, "cls").select("hub", "cls", "grp", "hub_grp", "n", "m", "tokens", "prefix", "na", "no")
    place = lambda n: F.pmod(F.xxhash64(F.lit(5), "cls"), F.col(n))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [F.col(c).alias(c) for c in ("hub", "cls", "grp", "n", "m", "tokens", "prefix")]  # own columns for either side
    inner = rows.select(*columns, place("na").alias("x"), other("no").alias("y"))
    outer = rows.where("grp != hub_grp").select(*columns, place("no").alias("y"), other("na").alias("x"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, groups, n, m = (right[c].to_numpy() for c in ("cls", "grp", "n", "m"))
            postings = []
            for lists in ([_unpacked(p) for p in right["prefix"]], [_unpacked(t) for t in right["tokens"]]):
                flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                order = np.argsort(flat, kind="stable")
                postings.append((owner[order], flat[order]))
            for cls, grp, own_n, own_m, raw, prefix in zip(*(left[c].to_pylist() for c in ("cls", "grp", "n", "m", "tokens", "prefix")), strict=True):
                same = _shared_counts(*postings[0], _unpacked(prefix), len(ids))
                maybe = (same >= np.minimum(m, own_m)) & (groups != grp) & (100 * np.minimum(n, own_n) >= percent * np.maximum(n, own_n))
                if maybe.any():
                    same = _shared_counts(*postings[1], _unpacked(raw), len(ids))
                    hit = ids[maybe & (100 * same >= percent * (n + own_n - same))]
                    a.append(np.full(len(hit), cls))
                    b.append(hit)
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    keys = ["hub", "x", "y"]
    return outer.groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def links_and_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of classes that join all classes which are linked, directly or in steps; doc_id, n and cls of every row."""
    share = bounded_batches(docs).sparkSession.sparkContext.broadcast
    texts, tokens_of = docs.select("text"), _of_texts(k)
    order = share(frequent(texts, tokens_of))
    shared = share(shared_bitmap(postings(texts, tokens_of, order, percent)))
    rows = _told_apart(saved(_picked(docs, order, shared, k, percent), "rows"))
    picked = rows.where("tokens IS NOT NULL").select("cls", "n", "tokens")
    return links_of_picked(picked, order, percent), rows.select("doc_id", "n", "cls")


def links_of_picked(picked: DataFrame, order: object, percent: int) -> DataFrame:
    """Links (a, b) that join all linked classes of a stored table of cls, n and tokens; those in two classes are found first."""
    shared = picked.sparkSession.sparkContext.broadcast(shared_bitmap(marks_of(picked)))
    sets = saved(_narrowed(picked, order, shared, percent).dropDuplicates(["cls"]), "sets")
    return links_of(sets, saved(_entries(sets), "entries"), percent)


def _enough(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes among postings a and b of one token, that meet in as many tokens as the smaller m."""
    first, second = F.least("a.cls", "b.cls"), F.greatest("a.cls", "b.cls")
    met = pairs.where(F.col("a.cls") != F.col("b.cls")).groupBy(first.alias("a"), second.alias("b")).agg(F.count("*").alias("met"), F.min(F.least("a.m", "b.m")).alias("least"))
    return met.where("met >= least").select("a", "b")


def links_of(sets: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all classes which are linked, directly or in steps.

    sets: cls, n, unshared, m, tokens and prefix (packed); entries: token, cls, n,
    unshared, m and place of the shingles by which candidates are sought. Both are stored tables.
    """
    posting = ["cls", "n", "unshared", "m", "place"]
    hub = F.min_by(F.struct(*posting), F.struct("unshared", F.xxhash64("cls"))).alias("b")
    stars = saved(entries.groupBy("token").agg(hub, F.count("*").alias("df")).where("df > 1").select("token", "b", "df"), "stars")
    lines = hot_keys(entries, "token")
    met = spread_join(entries.select("token", F.struct(*posting).alias("a")), stars.select("token", "b"), "token", lines)
    star_pairs = _enough(met.where(_may_link(percent)))
    star_links = saved(_verified(star_pairs, sets.select("cls", "n", "tokens"), percent, hot_keys(stars.select(F.col("b.cls").alias("b"), "df"), "b", "df")), "links")

    groups = components(star_links)
    entries = saved(entries.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component"), "entries")
    least = F.min_by(F.struct("cls", "grp"), F.struct("unshared", F.xxhash64("cls")))
    mixed = entries.groupBy("token").agg(least.alias("h"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("all")).where("lo != hi")
    open_ = saved(spread_join(entries, mixed.select("token", F.col("h.cls").alias("hub"), F.col("h.grp").alias("hub_grp"), "all"), "token", lines), "open")
    # postings so long that even one set beside each is many pairs go by blocks; in the others, the few pairs are joined
    near = saved(open_.where(F.col("all") > LONG).select("cls", "grp", "hub", "hub_grp").distinct(), "near")
    blocked = _between_groups(near, sets.select("cls", "n", "m", "tokens", "prefix"), percent)
    short = open_.where(F.col("all") <= LONG)
    once = (F.col("b.grp") == F.col("b.hub_grp")) | (F.col("a.cls") < F.col("b.cls"))
    pairs = short.where("grp != hub_grp").alias("a").join(short.alias("b"), F.col("a.token") == F.col("b.token")).where((F.col("a.grp") != F.col("b.grp")) & once & _may_link(percent))
    rest = saved(blocked.union(_verified(_enough(pairs), sets.select("cls", "n", "tokens"), percent)), "links")
    return star_links.union(rest)


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest doc_id that links reach, itself included."""
    links, rows = links_and_rows(docs, k, percent)
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc"))
    groups = components(links).withColumnRenamed("node", "cls")
    large = hot_keys(groups, "component")
    grouped = classes.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = grouped.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = spread_join(grouped, smallest, "component", large).select("cls", "component_id")
    found = spread_join(rows, of_class, "cls", hot_keys(rows, "cls"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's, one for each; rows that share an id with another text stay, as do those without an id."""
    found = linked_documents(docs, k, percent)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
