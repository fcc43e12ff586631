"""Fill-in-middle texts: prefix, suffix and middle by a streaming matcher of two passes.

A text is a run of units: words of letters A-Z a-z, or single other characters.
Two cut points are unit ranks drawn from a hash of the document's id. A first
pass over a lazy iterator of matches counts the units; a second one advances a
new iterator to the smaller rank and on to the larger, and takes the two
character positions. Neither holds more than one match, so a text of any length
costs no more memory than itself. The passes are the only Python: hashes, forms,
the cutting and its inverse are column functions, and no row is shuffled.

Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix,
prefix, middle), each part behind its marker. A text that is empty or holds a
marker stays plain, so a marker in a text that is not plain can only be one that
was put there, and restored() is exact.

Edge cases: a null text counts as empty; a null doc_id is hashed as no digits;
equal ids get equal draws. Either cut may lie at the start or the end, and both
may coincide: the parts may be empty. An empty table gives an empty result;
other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(key: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def count_units(text: str) -> int:
    """First pass."""
    return sum(1 for _ in UNIT.finditer(text))


def cut_positions(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the unit of rank first ends, and that of rank second (0 is the start); first <= second."""
    found = UNIT.finditer(text)
    ends, at, end = [], 0, 0
    for rank in (first, second):
        if rank > at:
            end = deque(islice(found, rank - at), maxlen=1)[0].end()
            at = rank
        ends.append(end)
    return ends[0], ends[1]


def _located(docs: DataFrame) -> DataFrame:
    """docs (with text, h1, h2 and plain) with n, and begin and end of the middle where the form is not plain."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("text", "h1", "h2", "plain")]
            n, begin, end = [], [], []
            for i in range(batch.num_rows):
                text, h1, h2, plain = (c[i].as_py() for c in columns)
                units = count_units(text)
                cuts = (None, None) if plain else cut_positions(text, *sorted((h1 % (units + 1), h2 % (units + 1))))
                n.append(units)
                begin.append(cuts[0])
                end.append(cuts[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (n, begin, end))], names=[*batch.schema.names, "n", "begin", "end"])

    return docs.mapInArrow(read, fields(docs, "n long, begin long, end long"))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, text (empty for null), n (units), form, prefix_chars, middle_chars (null if plain) and output.

    rate: percent of texts that are cut; suffix_first: percent of these that are spm.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(m))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"h1": h1, "h2": h2, "spm": h4 % 100 < suffix_first, "plain": (F.col("text") == "") | marked | (h3 % 100 >= rate)})
    found = _located(bounded_batches(rows))
    size = F.char_length("text")
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("begin")), part(F.col("begin"), F.col("end")), part(F.col("end"), size)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    form = F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    return found.select(
        "doc_id", "text", "n", form.alias("form"), F.col("begin").alias("prefix_chars"), (F.col("end") - F.col("begin")).alias("middle_chars"),
        F.when(F.col("plain"), F.col("text")).when(F.col("spm"), spm).otherwise(psm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made output of."""
    parts = F.split(output, "<[PSM]>", -1)
    piece = lambda i: F.get(parts, F.lit(i))
    whole = F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))
    return F.when(form == "plain", output).otherwise(whole)
