"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm import chat, decontamination, fingerprints, infill, jaccard, langid, mixing, pages, pii, quality, resampling, secrets, vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _n_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = secrets.span_text(F.col("base_spans")), secrets.span_text(F.col("spans"))
    return found.select("doc_id", *[_n_of(k, "base_spans") for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    shown = secrets.span_text(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[_n_of(k) for k in base], F.sha2(shown, 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(_read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), _read(spark, sf_dir, "labels"), columns=["doc_id"])
    return found.select("doc_id", "quality", "p_bad", "p_toxic", "site_rate", "keep")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the fingerprints: every document's class of near copies; op9's columns do not need it."""
    found = fingerprints.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_signatures", "class_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.to_json("takes").alias("takes"))


def op11_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_language_id, op3_personal_data, op4_secret_scan, op5_quality, op6_decontamination, op7_html_extraction, op8_jaccard_join, op9_fingerprints, fingerprint_classes, op10_source_mixing, op11_vector_duplicates, op12_fill_in_middle, op13_importance_resampling)}

def _secret_sql() -> str:
    """Matches and the pieces between them give positions; a run of hex digits is sought by its least length."""
    parts = []
    for no, r in enumerate(secrets.RULES):
        pattern = f"[0-9a-f]{{{r.least},}}" if r.kind == "hex" else r.pattern
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, {no} AS no, '{r.kind}' AS kind, m[i] AS shown, g[i] AS tested, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quoted}) AS m, regexp_extract_all(t, {quoted}, {r.group}) AS g, string_split_regex(t, {quoted}) AS b FROM d))
WHERE length(tested) >= {r.least}"""
        )
    found = " UNION ALL ".join(parts)
    base = [r.kind for r in secrets.RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    shown = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(shown) AS BIGINT), ',' ORDER BY start, no)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
s AS (SELECT doc_id, {counts}, {shown} AS spans, {shown} FILTER (WHERE no < {len(base)}) AS base FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations),
p AS (SELECT conv_id, k, max(k) OVER (PARTITION BY conv_id) AS n,
        string_agg(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n'), chr(30)) OVER w AS upto,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '') OVER w AS shown
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, upto, min(conv_id) AS conv_id, count(*) AS n_copies, min(shown) AS shown FROM p WHERE k = n GROUP BY n, upto)
SELECT conv_id, n AS n_turns, n_copies, shown || '<|end|>' AS text, length(shown || '<|end|>') AS n_chars FROM whole
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = whole.n AND p.upto = whole.upto)
""",
    "op4_secret_scan": _secret_sql(),
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS d, doc_id AS k FROM n UNION SELECT l.y, r.k FROM r JOIN l ON r.d = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.k, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(k) AS k FROM r GROUP BY d) m USING (doc_id)
""",
    "op11_vector_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id AS d, vec_id AS k FROM v UNION SELECT l.y, r.k FROM r JOIN l ON r.d = l.x),
m AS (SELECT d, min(k) AS k FROM r GROUP BY d)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.k AS component_id, vec_id = m.k AS kept FROM v JOIN m ON m.d = vec_id LEFT JOIN n ON n.x = vec_id
""",
    "op12_fill_in_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS h FROM h),
c AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
    "op13_importance_resampling": r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT doc_id AS id, 0 AS which, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT id, which, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT id, which, unnest(w) AS g FROM w UNION ALL SELECT id, which, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
n AS (SELECT id, which, g, count(*) AS n FROM f GROUP BY ALL),
e AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM n)),
c AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM e, t),
k AS (SELECT b, coalesce(sum(n) FILTER (WHERE which = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE which = 1), 0) AS t FROM n JOIN c USING (g) GROUP BY b),
z AS (SELECT b, floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM k) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM k) + 10000) AS DOUBLE))) AS gain FROM k),
y AS (SELECT id, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN c USING (g) JOIN z USING (b) WHERE which = 0 GROUP BY id),
d AS (SELECT doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM documents JOIN w ON w.id = doc_id AND which = 0 LEFT JOIN y ON y.id = doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE words >= 20)
SELECT doc_id, n_features, weight, score, rank FROM d LEFT JOIN (SELECT doc_id, rank FROM o WHERE rank <= 25 * n // 100) USING (doc_id)
""",
}
