"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

A conversation is logged again and again as it grows, so many logged rows are
prefixes of longer ones. Each turn gets the hash of its conversation up to
there: a running XOR of two 64-bit hashes of (position, role, text), where role
and text are hashed before anything is shuffled. A
conversation goes if another has its whole hash as the hash of a true prefix
(left anti join on length and hash), and of equal conversations the smallest
id stays. Only what stays is rendered: a bitmap of the ids that stay keeps the other
texts from being shuffled.

Prefix hashes are made distinct before the join (partial aggregation), so a
first turn that many conversations share is one row of it. Rows of one
conversation meet in one task, as its rendering is one string.

Edge cases: turns are ordered by turn (null first), then role, then text, in hashing as in
rendering, so ties and repeated rows have one order and repeats stay turns. Only
the first HEAD characters of a text are shuffled for that, and whole texts where different ones
begin alike in one turn and role. Gaps in turn do not count. A null role or text differs from an empty one in comparison and is
rendered empty. Rows with a null conv_id form one conversation. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.store import maybe_in, saved


HEAD = 64


def _hashed(conversations: DataFrame) -> DataFrame:
    """What is shuffled of each turn: two hashes of role and text, the head of the text, and the hash of all that orders it so far."""
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashes = {f"c{i}": F.xxhash64(F.lit(i), *parts) for i in (1, 2)}
    rows = conversations.select("conv_id", "turn", "role", "text", F.substring("text", 1, HEAD).alias("head"))
    return rows.withColumns(hashes | {"tie": F.xxhash64("conv_id", "turn", "role", "head")})


def _turns(conversations: DataFrame) -> DataFrame:
    rows = _hashed(conversations)
    order = ["conv_id", "turn", "role", "head", "c1", "c2", "tie"]
    ties = saved(rows.groupBy("tie").agg(F.max(F.char_length("text")).alias("longest"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]).where("(min_c1 != max_c1 OR min_c2 != max_c2)").where(F.col("longest") > HEAD).select("tie"), "ties")
    whole = F.lit(None).cast("string").alias("text")
    if ties.limit(1).count():  # different texts that begin alike in one place: these rows are ordered by the whole text
        tied = maybe_in(rows, ties, "tie").join(ties, "tie", "left_semi").select(*order, "text")
        hashed = rows.select(*order, whole).join(ties, "tie", "left_anti").select(*order, "text").union(tied)
    else:
        hashed = rows.select(*order, whole)
    place = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "head", "text")], "c1", "c2")
    turns = hashed.select("conv_id", F.row_number().over(place).cast("long").alias("k"), "c1", "c2")
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({f"h{i}": F.bit_xor(F.xxhash64(F.lit(i), "k", "c1", "c2")).over(upto) for i in (1, 2)}).withColumn("n_turns", F.max("k").over(Window.partitionBy("conv_id")))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one continues or repeats."""
    turns = _turns(conversations)
    whole = turns.where("k = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = turns.where("k < n_turns").select(F.col("k").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(conversations: DataFrame, turn_format: str = "<|%s|>\n%s\n", end: str = "<|end|>") -> DataFrame:
    """conv_id, n_turns, n_copies and text: the turns of each maximal conversation in order, then end."""
    kept = saved(maximal_conversations(conversations).withColumn("__key", F.xxhash64("conv_id")), "kept")
    turns = maybe_in(conversations.select("conv_id", "turn", "role", "text").withColumn("__key", F.xxhash64("conv_id")), kept, "__key")
    rows = turns.alias("c").join(kept.alias("m"), F.col("c.conv_id").eqNullSafe(F.col("m.conv_id")))
    turn = F.struct(F.col("c.turn"), F.col("c.role"), F.col("c.text"))
    chats = rows.groupBy(F.col("m.conv_id").alias("conv_id"), "n_turns", "n_copies").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.format_string(turn_format, F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))))
    return chats.select("conv_id", "n_turns", "n_copies", F.concat(F.array_join(shown, ""), F.lit(end)).alias("text"))
