"""Secret scan by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression with the least length of one group. From the
expression itself a Boolean trigram query is derived (trigram_query()): any one of
several sets of trigrams, all of them, that every match must hold, case aside. The
index holds (trigram, row) for the trigrams that some query names, over texts in
lower case. Each set has a leading trigram, the one of the rarest characters: the others of a set are sought
only in texts that hold it, as their postings could not meet elsewhere. A grouped count intersects
the postings of each set; what remains are candidates, on whose texts the expression is run. A rule without a mandatory
trigram, such as a run of hex digits, is run on all texts in the scan that reads them.

A bitmap of the candidates' hashes, sized by their number up to MOST_BITS, is
broadcast: only texts of rows that it holds are shuffled to their candidates, and
of these only the spans found go on. Where there are more candidates than the bitmap
can tell apart, more texts are shuffled; none is left out. A row is known by two hashes of its
id and text, so null and repeated ids spread, and equal rows are looked at once.

Matches are leftmost and do not overlap within a rule. Positions come from the
pieces that split() leaves between them, in code points, end exclusive: they are summed within blocks
of BLOCK matches and then over the blocks, so a text's work is in proportion to its matches.

Edge cases: a null or empty text has no spans; rows with a null or repeated doc_id are
told apart by their texts; an empty table gives an empty result; extra columns of the
input are kept, those named like an output column replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import maybe_in, saved

ALL = (frozenset(),)
#: Strings that a part of an expression may be spelt out to, alternatives of a query, and characters of a class.
SPELT, ALTERNATIVES, MEMBERS = 64, 64, 8
#: Bits of the candidates' bitmap: BITS_EACH for each, MOST_BITS at most (8 MB).
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Matches of one text whose positions are summed together.
BLOCK = 256
# Letters of English, the most frequent first.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
_parser = re._parser  # the standard library's own reader of expressions
Query = tuple[frozenset[str], ...]


def _trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def _thinned(members: frozenset[str]) -> frozenset[str]:
    """members without those that overlap with two others: a shorter question with nearly the same answer."""
    left = set(members)
    for t in sorted(members):
        if any(u != t and u[1:] == t[:2] for u in left) and any(u != t and u[:2] == t[1:] for u in left):
            left.discard(t)
    return frozenset(left)


def _of(words: set[str]) -> Query:
    return ALL if any(len(w) < 3 for w in words) else _any(*[(_trigrams(w),) for w in sorted(words)])


def _any(*queries: Query) -> Query:
    """Alternatives; those that ask more than another are left out."""
    sets = {s for q in queries for s in q}
    least = tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return least if len(least) <= ALTERNATIVES else ALL


def _both(a: Query, b: Query) -> Query:
    return _any(tuple({x | y for x in a for y in b})) if len(a) * len(b) <= ALTERNATIVES else min(a, b, key=len)


def _sequence(items: list) -> tuple[set[str] | None, Query]:
    run, query, exact = {""}, ALL, True
    for item in items:
        words, asked = _item(*item)
        if words is not None and len(run) * len(words) <= SPELT:
            run = {a + b for a in run for b in words}
            continue
        query, exact = _both(query, _both(_of(run), asked if words is None else _of(words))), False
        run = {""}
    return (run, ALL) if exact else (None, _both(query, _of(run)))


def _item(op: object, value: object) -> tuple[set[str] | None, Query]:
    """What one item of a parsed expression can be: a few words in lower case, or anything that fulfils a query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, ALL
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in value) and len(value) <= MEMBERS:
            return {chr(c).lower() for _, c in value}, ALL
        return None, ALL
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, ALL
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        parts = [_sequence(x) for x in value[1]]
        if all(w is not None for w, _ in parts) and sum(len(w) for w, _ in parts) <= SPELT:
            return set().union(*[w for w, _ in parts]), ALL
        return None, _any(*[q if w is None else _of(w) for w, q in parts])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        words, query = _sequence(inner)
        if words is not None and (least, int(most)) == (0, 1):
            return words | {""}, ALL
        if words is not None and least == most and len(words) ** least <= SPELT:
            return _sequence(list(inner) * least)
        return None, ALL if least == 0 else query if words is None else _of(words)
    return None, ALL


@lru_cache(maxsize=64)
def trigram_query(pattern: str) -> Query:
    """Sets of trigrams: every match, in lower case, holds all members of one of them at least; () if nothing is mandatory."""
    words, query = _sequence(list(_parser.parse(pattern)))
    query = query if words is None else _of(words)
    return () if frozenset() in query else tuple(_thinned(s) for s in query)


@dataclass(frozen=True)
class Rule:
    """A pattern whose group is least characters long; base rules are those of the contract, the others add to them."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    def trigrams(self) -> Query:
        return trigram_query(self.pattern)


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x09-\x0D\x20]*(?:[A-Za-z0-9-]+:[^\x0A\x0D]*[\x0A\x0D]+){0,8}[A-Za-z0-9+/=\x09-\x0D\x20]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("connection", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s?ftp)://[^\x00-\x20:@/]{1,64}:[^\x00-\x20@/]{4,128}@[A-Za-z0-9.-]+"),
    Rule("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    Rule("bearer", r"""(?i:authorization)["']?\x20*[:=]\x20*["']?(?i:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)""", 1, 8),
)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __k1 and __k2, which tell rows apart."""
    return docs.withColumns({"__k1": F.xxhash64(F.lit(1), "doc_id", F.col("doc_id").isNull(), "text"), "__k2": F.xxhash64(F.lit(2), "text", "doc_id")})


def _leading(clause: frozenset[str]) -> str:
    """The trigram of the rarest characters; what is no letter counts as rare."""
    return max(sorted(clause), key=lambda t: sum(FREQUENT.index(c) if c in FREQUENT else len(FREQUENT) for c in t))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (trigram, __k1, __k2) for the trigrams that the rules' queries name, in texts with the leading trigram of a set that has them; a posting may occur twice."""
    led: dict[str, set[str]] = {}
    for clause in (s for r in rules for s in r.trigrams()):
        led.setdefault(_leading(clause), set()).update(clause)

    def held(low: Column) -> Column:
        def sought(t: str) -> Column:
            return F.when(F.contains(low, F.lit(t)), F.lit(t))

        sets = [F.when(F.contains(low, F.lit(t)), F.array(F.lit(t), *[sought(u) for u in sorted(others - {t})])) for t, others in sorted(led.items())]
        return F.array_compact(F.flatten(F.array_compact(F.array(*sets)))) if sets else F.array().cast("array<string>")

    # a lambda takes the lowered text once; as a column of its own it would be put into each of the tests
    found = F.transform(F.array(F.lower(F.col("text"))), held)
    return _keyed(docs.select("doc_id", "text")).select("__k1", "__k2", F.explode(F.flatten(found)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__k1, __k2, kinds): per row the rules whose query its postings fulfil."""
    sets = [(r.kind, f"{r.kind}{i}", t, len(s)) for r in rules for i, s in enumerate(r.trigrams()) for t in sorted(s)]
    queries = index.sparkSession.createDataFrame(sets, "kind string, clause string, trigram string, need int")
    hits = index.join(F.broadcast(queries), "trigram").groupBy("__k1", "__k2", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("have"))
    return hits.where("have = need").groupBy("__k1", "__k2").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """Array of (start, no, end, kind) of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    all_of = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else all_of
    sizes = F.zip_with(F.split(text, rule.pattern, -1), F.arrays_zip(all_of.alias("m"), tested.alias("g")), lambda before, x: F.struct(F.char_length(before).alias("before"), F.char_length(x["m"]).alias("len"), F.char_length(x["g"]).alias("tested")))
    spot = f"struct<at:int,spans:{SPANS}>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")).cast(spot)

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["before"]
        end = start + F.coalesce(x["len"], F.lit(0))
        spans = F.when(F.coalesce(x["tested"], F.lit(0)) >= rule.least, F.concat(a["spans"], F.array(span(start, end)))).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(spot)

    def in_blocks(all_sizes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_sizes), F.lit(BLOCK))
        return F.transform(starts, lambda i: F.aggregate(F.slice(all_sizes, i, F.lit(BLOCK)), first, step))

    def placed(blocks: Column) -> Column:
        ahead = F.aggregate(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, ahead, lambda b, at: F.transform(b["spans"], lambda s: span(s["start"] + at, s["end"] + at))))

    # lambdas take what is used twice once
    blocks = F.transform(F.array(sizes), in_blocks)
    return F.flatten(F.transform(blocks, placed)).cast(SPANS)


def _scan(rule: Rule) -> Rule:
    """The same matches of a one-class run, sought by its least length: shorter runs are never built."""
    if rule.kind == "hex" and rule.pattern == r"[0-9a-f]+":
        return Rule(rule.kind, rf"[0-9a-f]{{{rule.least},}}", 0, rule.least)
    return rule


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with spans: array of (start, no, end, kind), by start and then by the order of the rules."""
    docs = _keyed(docs.drop("spans", "__k1", "__k2"))
    found = saved(candidates(postings(docs, rules), rules), "candidates")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPANS)
    numbered = list(enumerate(rules))
    tested = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, no)).otherwise(none) for no, r in numbered if r.trigrams()]
    verified = maybe_in(docs.select("__k1", "__k2", "text"), found, "__k1", BITS_EACH, MOST_BITS).join(found, ["__k1", "__k2"]).select("__k1", "__k2", F.concat(none, *tested).alias("__spans"))
    verified = verified.where(F.size("__spans") > 0).dropDuplicates(["__k1", "__k2"])
    scanned = [F.when(F.rlike(text, F.lit(r.pattern)), _spans(text, r, no)).otherwise(none) for no, r in ((no, _scan(r)) for no, r in numbered if not r.trigrams())]
    rows = docs.withColumn("__scanned", F.concat(none, *scanned)).join(verified, ["__k1", "__k2"], "left")
    return rows.select(*[f"`{c}`" for c in docs.columns if c not in ("__k1", "__k2")], F.array_sort(F.concat("__scanned", F.coalesce("__spans", none))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
