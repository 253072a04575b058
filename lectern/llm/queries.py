"""The numbered operators as queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, fill_middle, filter_audit, fingerprints, language_id, mixing, order_minhash, passages, pivot_index, quality_gam, sentencepiece_codec, suffix_dedup, url_filter
from lectern.llm.common import crc32_mod4

#: The model file that op5 encodes with; LECTERN_SENTENCEPIECE_MODEL names another.
MODEL = os.environ.get("LECTERN_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out() -> Column:
    """Whether a row is held out of learning; one without doc_id is neither held out nor learned from."""
    return F.coalesce(crc32_mod4("doc_id") == 2, F.lit(False)).alias("held_out")


def model_bytes() -> bytes:
    """Content of the SentencePiece model file, read once on the driver; tasks get it by broadcast."""
    return Path(MODEL).read_bytes()


def op1_language_id(spark, d):
    """The language of every text; learned from the rows that aren't held out."""
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang", _held_out())
    filters = language_id.learn(docs.where(crc32_mod4("doc_id") != 2))
    return language_id.identify(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op2_embedding_dedup(spark, d):
    """Links and components of all vectors."""
    return pivot_index.near_duplicates(_table(spark, d, "embeddings"))


def op3_fingerprints(spark, d):
    """Fingerprints of every text and of its edited text."""
    made = fingerprints.fingerprint_documents(_table(spark, d, "documents"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )  # fmt: skip


def op4_url_filter(spark, d):
    """A verdict for every page."""
    return url_filter.judge_pages(_table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op6_passages(spark, d):
    """Every repeated passage and the place that it repeats."""
    return passages.repeated_passages(_table(spark, d, "documents").select("doc_id", "text"))


def op7_mixing(spark, d):
    """What the mix takes of every document, range-sorted by training position; what it leaves comes after."""
    plan = mixing.plan_mix(_table(spark, d, "documents").select("doc_id", "text", "source")).drop("text", "source")
    late = 2 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    return plan.orderBy(F.coalesce("position", late), "doc_id")


def op5_sentencepiece(spark, d):
    """Token ids of every text, whether they decode to it, and parity with the sentencepiece library."""
    content = model_bytes()
    sentencepiece_codec.build(content)
    made = sentencepiece_codec.encoded(_table(spark, d, "documents").select("doc_id", "text"), content)
    return made.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", sentencepiece_codec.round_trip().alias("round_trip"), "parity")


def op8_suffix_dedup(spark, d):
    """What every document keeps when 400-byte strings that stand elsewhere go, and that text (bytes of split code points replaced)."""
    made = suffix_dedup.remove_repeats(_table(spark, d, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_order_minhash(spark, d):
    """Class and verified links of every document."""
    return order_minhash.near_duplicates(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept", "n_links")


def op10_quality(spark, d):
    """A quality score for every text; learned from the labels that aren't held out."""
    docs = _table(spark, d, "documents").select("doc_id", "text", _held_out())
    model = quality_gam.learn(docs.where(crc32_mod4("doc_id") != 2), _table(spark, d, "labels"))
    return quality_gam.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark, d):
    """Every text cut for filling in its middle, and the text read back off that."""
    made = fill_middle.restored(fill_middle.fill_in_middle(_table(spark, d, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )  # fmt: skip


def op12_exact_dedup(spark, d):
    """The group of equal texts of every document, and which of them stays."""
    made = exact_dedup.exact_duplicates(_table(spark, d, "documents"), hash_all=True)
    return made.select("doc_id", "keep_id", "group_size", "kept", F.col("text_hash").alias("text_sha256"))


def op13_filter_audit(spark, d):
    """What five filters do in all their orders, for each source."""
    masks = filter_audit.document_masks(_table(spark, d, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(masks, _table(spark, d, "labels")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_url_filter": op4_url_filter,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_passages": op6_passages,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_order_minhash": op9_order_minhash,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_filter_audit": op13_filter_audit,
}


def _op7_oracle() -> str:
    def position(taken, at):
        cases = " ".join(f"WHEN slot = {i} THEN {mixing.time_of(f'(CAST({at} AS DOUBLE) / target)', s)}" for i, s in enumerate(mixing.SCHEDULES))
        # DuckDB reads 0.5 as a decimal and 5e-1 as a double; Spark's suffix D is unknown to it.
        return re.sub(r"([\d.]+)D", r"CAST(\1 AS DOUBLE)", f"CASE WHEN {taken} > 0 THEN CASE {cases} END END")

    weights = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS m
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS slot
  FROM sized GROUP BY source),
capped AS (
  SELECT *, CAST(CASE slot {weights} END AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * {mixing.MOST} AS cap FROM named),
filled AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () * {mixing.SHARE} - coalesce(sum(cap) OVER f, 0) AS lft,
         sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS wleft
  FROM capped WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT max(lft) AS l, max(wleft) AS wl FROM filled WHERE NOT cap * wleft <= lft * w),
targets AS (
  SELECT source, slot, source_size, CASE WHEN cap * wleft <= lft * w THEN cap ELSE l * w / wl END AS target FROM filled, open),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slot,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY m, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS offs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
halves AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - offs)) AS one,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - offs)) AS two FROM placed)
SELECT doc_id, size, source_size, target, one + two AS taken,
       {position("one", "offs")} AS position, {position("two", "offs + source_size")} AS position_again
FROM halves"""


_OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k,
         CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, CAST(len(k) AS BIGINT) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_middle.PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM w),
p AS (
  SELECT doc_id, t, n, form, array_to_string(k[1:a], '') AS prefix, array_to_string(k[a + 1:b], '') AS middle, array_to_string(k[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""

_OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
f AS (
  SELECT doc_id, part,
         CAST(len(w) < {filter_audit.LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w) AS INT)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > {filter_audit.MOST_CAPITALS} * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS earlier
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
t AS (SELECT *, coalesce(CAST(earlier AS INT), 0) AS before FROM s)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM c, t GROUP BY part, filter_order, step"""

ORACLES: dict[str, str] = {"op7_mixing": _op7_oracle(), "op11_fill_in_middle": _OP11, "op12_exact_dedup": _OP12, "op13_filter_audit": _OP13}
