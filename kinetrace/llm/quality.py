"""Document quality by a classifier and hierarchical empirical Bayes over sites.

A classifier with two heads (bad writing, toxic) is fitted on about FIT_ROWS
labelled rows drawn by hash: logistic regression on hashed words (whether they
occur) and a few figures of style. It scores every whole text. The share of
acceptable documents then has a posterior at three levels: all documents, host,
and path within the host. Each level is a beta prior around the posterior mean
of the level above, whose strength follows from the spread between its members
(method of moments), so sparse sites shrink to their parent. A document's
posterior is its own evidence shifted by how far its path's posterior lies from
the global share. Documents below THRESHOLD, or toxic above it, are rejected.

Sites are aggregated with partial sums before any shuffle: a host with a third
of all rows is a row per task. Their table is broadcast up to BROADCAST_SITES
paths and joined by shuffle beyond.

The host is the source up to the first slash; the path is the rest of the source
(its last part left out), or the language where there is none.

Edge cases: null text is empty and has only style figures; null source or lang
make a site of their own. Without labels nothing is rejected on evidence (both
heads give PRIOR). Labels with null marks are not used; of several labels of a document
the majority counts (a tie is bad, or toxic), of several texts with one id the one with the least hash is
learnt from. Repeated rows each count in their sites. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields, hot_keys, saved, spread_join
from kinetrace.llm.words import PUNCTUATION, slices, word_hashes

FIT_ROWS = 20_000
DIMS = 1 << 16
THRESHOLD, PRIOR = 0.5, 0.05
BROADCAST_SITES = 20_000
#: A word is chosen if its share differs between classes by so many standard errors; at most so many for each head.
STRONG, MOST_WORDS = 4.0, 300
#: Of a path's shift against the global share, the part that counts as evidence on a document.
SITE_WEIGHT = 0.5
OUTPUTS = ("p_bad", "p_toxic", "site_rate", "quality", "keep")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct word buckets of each text, and its figures of style."""
    hashes, _, _, first = word_hashes(data, offsets, PUNCTUATION, latin=True)
    buckets = (hashes >> np.uint64(40)).astype(np.int64) % DIMS

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    upper = per_text((data >= 65) & (data <= 90))
    lower = per_text(((data >= 97) & (data <= 122)) | (data >= 128))
    digit = per_text((data >= 48) & (data <= 57))
    marks = per_text(PUNCTUATION[data] & (data > 32) & (data != 44) & (data != 46))
    size = np.maximum(np.diff(offsets), 1)
    words = np.diff(first)
    lists = [np.unique(buckets[first[i] : first[i + 1]]) for i in range(len(words))]
    distinct = np.array([len(x) for x in lists])
    n = np.maximum(words, 1)
    expected = np.minimum(1.0, 1.6 * n ** -0.12)  # of distinct words in prose of this length, roughly
    style = np.stack([upper / (upper + lower + 1), digit / size, marks / size, np.minimum(marks / n, 2), distinct / n, np.minimum(distinct / n / expected, 1), np.log1p(words) / 8, size / n / 20], axis=1)
    return lists, np.clip(style, 0, 3)


class Classifier:
    """Weights of both heads: column 0 bad writing, column 1 toxic."""

    def __init__(self, words: np.ndarray, style: np.ndarray, bias: np.ndarray):
        self.words, self.style, self.bias = words, style, bias
        self.used = words.any(axis=1)

    def logits(self, lists: list[np.ndarray], style: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in lists])
        flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(lists)), sizes)
        hit = self.used[flat]
        flat, doc = flat[hit], doc[hit]
        z = _squares(style) @ self.style + self.bias
        for k in (0, 1):
            z[:, k] += np.bincount(doc, weights=self.words[flat, k], minlength=len(lists))
        return z


def _squares(style: np.ndarray) -> np.ndarray:
    return np.concatenate([style, style**2], axis=1)


def _ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton steps on the log loss; the last column of x is the constant and is not shrunk."""
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


def chosen_words(have: np.ndarray, among: np.ndarray, n: int, yes: int) -> np.ndarray:
    """Buckets whose frequency differs most between yes of n documents and the rest; have and among count documents by bucket."""
    if not 0 < yes < n:
        return np.zeros(0, np.int64)
    rate = have / n
    error = np.sqrt(rate * (1 - rate) * (1 / yes + 1 / (n - yes))) + 1e-9
    z = np.where(have >= 5, np.abs(among / yes - (have - among) / (n - yes)) / error, 0)
    pick = np.argsort(-z, kind="stable")[:MOST_WORDS]
    return pick[z[pick] >= STRONG]


def train(lists: list[np.ndarray], style: np.ndarray, labels: np.ndarray, picked: list[np.ndarray], ridge: float = 0.2) -> Classifier:
    """Ridge logistic regression on style and the words picked for each head; labels has a column for each head."""
    n = len(lists)
    flat, doc = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
    squares = _squares(style)
    mean, spread = squares.mean(axis=0), squares.std(axis=0) + 1e-3
    words, weights, bias = np.zeros((DIMS, 2)), np.zeros((squares.shape[1], 2)), np.zeros(2)
    for k in (0, 1):
        y, pick = labels[:, k], picked[k]
        if not 0 < y.sum() < n:
            bias[k] = _odds(y.mean())
            continue
        column = np.full(DIMS, -1)
        column[pick] = np.arange(len(pick))
        x = np.zeros((n, len(pick) + squares.shape[1] + 1))
        at = column[flat]
        x[doc[at >= 0], at[at >= 0]] = 1
        x[:, len(pick) : -1] = (squares - mean) / spread
        x[:, -1] = 1
        w = _ridge_logistic(x, y, ridge)
        words[pick, k] = w[: len(pick)]
        weights[:, k] = w[len(pick) : -1] / spread
        bias[k] = w[-1] - (w[len(pick) : -1] * mean / spread).sum()
    return Classifier(words, weights, bias)


def _odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier | None:
    """A classifier from about fit_rows labelled rows; None if there are none."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    marks = marks.agg((F.avg((F.col("quality") == 0).cast("int")) >= 0.5).alias("bad"), (F.avg((F.col("toxic") == 1).cast("int")) >= 0.5).alias("toxic"))
    total = marks.count()
    if total > fit_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * fit_rows / total))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b["text"]):
                lists, style = features(data, offsets)
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], b["bad"][lo:hi], b["toxic"][lo:hi], pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())), pa.array(list(style), pa.list_(pa.float64()))], names=["doc_id", "bad", "toxic", "words", "style"])

    found = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    marked = found.groupBy("doc_id", "bad", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = fields(marked.drop("text"), "words array<int>, style array<double>")
    sample = saved(marked.mapInArrow(read, kind), "marked")
    counts = sample.select("bad", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("have"), F.count_if("bad").alias("bad"), F.count_if("toxic").alias("toxic")).toArrow()  # DIMS rows at most
    sums = sample.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if("toxic").alias("toxic")).first()
    if not sums.n:
        return None
    have, among = np.zeros(DIMS), {h: np.zeros(DIMS) for h in ("bad", "toxic")}
    at = counts["word"].to_numpy()
    have[at] = counts["have"].to_numpy()
    for h in among:
        among[h][at] = counts[h].to_numpy()
    picked = [chosen_words(have, among[h], sums.n, sums[h]) for h in among]
    wanted = F.lit([int(x) for x in np.unique(np.concatenate(picked))]).cast("array<int>")
    rows = sample.withColumn("words", F.array_intersect("words", wanted)).toArrow().sort_by([("doc_id", "ascending")])  # fit_rows rows of 2 * MOST_WORDS words at most
    lists = [np.asarray(x, np.int64) for x in rows["words"].to_numpy(zero_copy_only=False)]
    marks_ = np.stack([rows["bad"].to_numpy(zero_copy_only=False), rows["toxic"].to_numpy(zero_copy_only=False)], axis=1).astype(float)
    return train(lists, np.stack(rows["style"].to_numpy(zero_copy_only=False)), marks_, picked)


def evidence(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """docs with p_bad and p_toxic, the classifier's chances for each whole text."""
    docs = bounded_batches(docs).drop("p_bad", "p_toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((b.num_rows, 2), PRIOR)
            for lo, hi, data, offsets in slices(b["text"]):
                if shared.value is not None:
                    out[lo:hi] = 1 / (1 + np.exp(-np.clip(shared.value.logits(*features(data, offsets)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*b.schema.names, "p_bad", "p_toxic"])

    return docs.mapInArrow(score, fields(docs, "p_bad double, p_toxic double"))


def host_of(source: Column) -> Column:
    return F.substring_index(source, "/", 1)


def path_of(source: Column, lang: Column) -> Column:
    below = F.regexp_extract(source, r"^[^/]*/(.*)/[^/]*$", 1)
    return F.when(F.length(below) > 0, below).otherwise(lang)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def site_table(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, good, n, h_good, h_n) from rows with host, path, p_bad and p_toxic; good and n of all, and the strength of either prior."""
    good = (1 - F.col("p_bad")) * (1 - F.col("p_toxic"))
    paths = saved(scored.groupBy("host", "path").agg(F.sum(good).alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("n").alias("h_n"))

    def strength(table: DataFrame, good_: str, n: str, parent: Column) -> float:
        """Prior documents: base variance over the spread between members beyond that of chance."""
        mean = F.col(good_) / F.col(n)
        r = table.select(parent.alias("m"), mean.alias("x"), F.col(n).alias("n")).agg(
            F.sum(F.col("n") * (F.col("x") - F.col("m")) ** 2).alias("ss"),
            F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("base"),
        ).first()
        if not r.n:
            return 100.0
        between = max((r.ss - r.chance) / r.n, 1e-6)
        return float(np.clip(r.base / r.n / between, 2.0, 10_000.0))

    sums = paths.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    base = sums.good / sums.n if sums.n else 1 - PRIOR
    k_host = strength(hosts, "h_good", "h_n", F.lit(float(base)))
    known = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h_good", "h_n")
    k_path = strength(known, "good", "n", (F.col("h_good") + k_host * base) / (F.col("h_n") + k_host))
    return known, {"good": float(sums.good), "n": float(sums.n), "k_host": k_host, "k_path": k_path}


def rates(known: dict[str, float], site: dict[str, Column], own: Column, count: int) -> tuple[Column, Column]:
    """Posterior shares of a path and of all documents, without count documents whose good is own; site: good, n, h_good and h_n."""
    rest = known["n"] - count
    base = (known["good"] - own) / rest if rest > 0 else F.lit(1 - PRIOR)
    host = (site["h_good"] - own + known["k_host"] * base) / (site["h_n"] - count + known["k_host"])
    return (site["good"] - own + known["k_path"] * host) / (site["n"] - count + known["k_path"]), base


def assess(docs: DataFrame, labels: DataFrame, model: Classifier | None = None, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) with p_bad, p_toxic, site_rate (without the document), quality (posterior of being acceptable) and keep.

    Without text among the columns each text is scored once and the scores are stored; with it, scored again in the result.
    """
    docs = docs.drop(*OUTPUTS)
    columns = docs.columns if columns is None else columns
    model = model or fit(docs, labels)
    placed = {"__host": host_of(F.col("source")), "__path": path_of(F.col("source"), F.col("lang"))}
    scored = evidence(docs, model).withColumns(placed)
    slim = scored.select(*[f"`{c}`" for c in columns if c != "text"], "__host", "__path", "p_bad", "p_toxic")
    if "text" not in columns:
        scored = slim = saved(slim, "scored")
    else:
        slim = evidence(docs.select("text", "source", "lang"), model).withColumns(placed)
    table, known = site_table(slim.select(F.col("__host").alias("host"), F.col("__path").alias("path"), "p_bad", "p_toxic"))
    sites = saved(table.select(*[F.col(c).alias(f"__s_{c}") for c in table.columns]), "sites")
    here = F.col("__host").eqNullSafe(F.col("__s_host")) & F.col("__path").eqNullSafe(F.col("__s_path"))
    if sites.count() <= BROADCAST_SITES:
        rows = scored.join(F.broadcast(sites), here)
    else:  # a site goes to as many tasks as its documents ask for
        keyed = saved(sites.withColumn("__site", F.xxhash64("__s_host", "__s_path")), "sites")
        rows = spread_join(scored.withColumn("__site", F.xxhash64("__host", "__path")), keyed, "__site", hot_keys(keyed, "__site", "__s_n")).where(here)
    good = (1 - F.col("p_bad")) * (1 - F.col("p_toxic"))
    site, base = rates(known, {c: F.col(f"__s_{c}") for c in ("good", "n", "h_good", "h_n")}, good, 1)
    posterior = _logit(good) + F.lit(SITE_WEIGHT) * (_logit(site) - _logit(base))
    quality = 1 / (1 + F.exp(-posterior))
    keep = (quality >= THRESHOLD) & (F.col("p_toxic") < THRESHOLD)
    return rows.select(*[f"`{c}`" for c in columns], "p_bad", "p_toxic", site.alias("site_rate"), quality.alias("quality"), keep.alias("keep"))
