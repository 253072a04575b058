"""Planning queries: masks derived from document and paragraph numbers stand for a model's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import paragraphs as P, planning as M
from lectern.plans.text_plans import CHUNK_FOLD_SQL, PARAS_SQL, PIECES_SQL, SENTS_SQL, UNITS_SQL
from lectern.sources.tables import table

RULES = "Group the sentences."


def _paras(spark, d):
    """Paragraphs with their sentences and a mask: every fourth has none, others all ones, a pattern with a stray digit, or a short one."""
    p = X.settled(P.paragraphs(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "para", value=X.sentences(F.col("text")), name="sents")
    kind, n = (F.col("doc_id") + F.col("para")) % 4, F.size("sents")
    mask = F.when(kind == 1, F.repeat(F.lit("1"), n)).when(kind == 2, F.concat(F.substring(F.repeat(F.lit("1001000100"), n), F.lit(1), n * 9), F.lit("2"))).when(kind == 3, F.lit("0"))
    return p.withColumn("mask", mask)


def prompt(spark, d):
    return M.prompts(P.sentences(P.paragraphs(table(spark, d, "documents").select("doc_id", "text"))), RULES)


def answers(spark, d):
    """Answers with thoughts, drafts and fences around their objects, from conversations' turns."""
    c = table(spark, d, "conversations")
    n = F.length("text").cast("string")
    shown = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('<think>{"breaks": {}}</think>{"breaks": {"0": "1'), n, F.lit('"}}')))
    shown = shown.when(F.col("turn") % 4 == 1, F.concat(F.lit('Draft {"breaks": {"0": "0"}} then\n```json\n{"breaks": {"1": "}'), n, F.lit('{"}}\n```')))
    shown = shown.when(F.col("turn") % 4 == 2, F.concat(F.lit('{"groups": [{"para": 0, "from": 0, "to": '), n, F.lit("}]}")))
    reasoning = F.when(F.col("role") == "user", F.lit('so {"breaks": {"2": "10"}} or {broken'))
    made = c.select("conv_id", "turn", M.json_object(M.answer_text(shown, reasoning)).alias("answer"))
    breaks, groups = M.breaks_of(F.col("answer")), M.legacy_groups(F.col("answer"))
    return made.select("conv_id", "turn", F.map_values(breaks)[0].alias("mask"), F.element_at(groups, 1)["to"].alias("to"))


def mask_groups(spark, d):
    g = M.grouped(_paras(spark, d))
    return X.each(g, "doc_id", "para", "by_mask", value=F.col("groups"), names=("n", "g")).select("doc_id", "para", "by_mask", "n", F.col("g.from").alias("s0"), F.col("g.to").alias("s1"))


def validity(spark, d):
    return M.checked(M.grouped(_paras(spark, d)))


def _by_mask(g):
    """Groups of masks only, others null. A filter would be pushed below the sentences, which it would then compute again for every place that asks for their number."""
    return g.withColumn("groups", F.when(F.col("by_mask"), F.col("groups")))


def folds(spark, d):
    g = _by_mask(M.grouped(_paras(spark, d)))
    return X.each(g, "doc_id", "para", value=M.folded(F.col("groups"), F.col("sents")), names=("n", "g")).select("doc_id", "para", "n", F.col("g.from").alias("s0"), F.col("g.to").alias("s1"), F.col("g.size").alias("size"))


def cut_chunks(spark, d):
    return M.chunks_of_groups(_by_mask(M.grouped(_paras(spark, d))))


def report(spark, d):
    docs = M.checked(M.grouped(_paras(spark, d)))
    reason = F.when(~F.col("valid"), F.when(F.col("by_mask") == 0, F.lit("bad_json")).otherwise(F.lit("bad_groups")))
    return M.planner_report(docs.select("doc_id", F.col("valid").alias("used"), reason.alias("reason")), "stub")


QUERIES = {
    "M1_prompt": prompt, "M2_M10_answers": answers, "M3_groups": mask_groups, "M4_valid": validity, "M5_fold": folds, "M6_recut": cut_chunks, "M9_A9_report": report,
}

_MASKS = f"""{PARAS_SQL}, {SENTS_SQL},
listed AS (SELECT doc_id, para, list(text ORDER BY sent) AS sents, count(*) AS n FROM sents GROUP BY 1, 2),
masked AS (SELECT *, CASE (doc_id + para) % 4 WHEN 1 THEN repeat('1', n) WHEN 2 THEN repeat('1001000100', n)[1:n * 9] || '2' WHEN 3 THEN '0' END AS mask FROM listed),
used AS (SELECT *, coalesce(mask <> '' AND len(regexp_extract_all(mask, '[01]')) / length(mask) >= 0.9, false) AS by_mask FROM masked),
fixed AS (SELECT *, '1' || rpad(regexp_replace(mask, '[^01]', '0', 'g'), CAST(n AS INTEGER), '0')[2:n] AS m FROM used),
starts AS (SELECT *, list_filter(range(n), lambda i: m[i + 1] = '1') AS s FROM fixed),
own AS (SELECT doc_id, para, sents, n, by_mask, CASE WHEN by_mask THEN list_transform(s, lambda x, i: struct_pack(f := CAST(x AS INTEGER), t := CAST(coalesce(s[i + 1], n) - 1 AS INTEGER))) END AS g FROM starts)"""
_UNITS_OF = f"""{UNITS_SQL}, {PIECES_SQL}, {CHUNK_FOLD_SQL}"""
_GROUPS = f"""{_MASKS}, {_UNITS_OF},
packed AS (SELECT doc_id, para, list_transform(c, lambda x: struct_pack(f := x.s0, t := x.s1)) AS g FROM folded_chunks),
groups AS (SELECT o.doc_id, o.para, o.sents, o.n, o.by_mask, CASE WHEN o.by_mask THEN o.g ELSE p.g END AS g FROM own o LEFT JOIN packed p USING (doc_id, para))"""
_VALID = f"""{_GROUPS},
flat AS (SELECT doc_id, para, n, by_mask, unnest(g) AS x FROM groups),
ord AS (SELECT *, row_number() OVER w AS k, coalesce(lag(x.t) OVER w + 1, 0) AS want FROM flat WINDOW w AS (PARTITION BY doc_id, para ORDER BY x.f, x.t)),
per AS (SELECT doc_id, para, any_value(by_mask) AS by_mask, bool_and(x.f = want AND x.f <= x.t AND x.t < n) AND arg_max(x.t, k) = any_value(n) - 1 AS ok FROM ord GROUP BY 1, 2),
valid AS (SELECT doc_id, count(*) AS paras, count(*) FILTER (by_mask) AS by_mask, bool_or(by_mask) AND bool_and(ok) AS valid FROM per GROUP BY 1)"""
_FOLD = f"""sized AS (SELECT doc_id, para, sents, list_transform(g, lambda x: [struct_pack(f := x.f, t := x.t, size := length(array_to_string(sents[x.f + 1:x.t + 1], ' ')))]) AS e FROM own WHERE by_mask),
fold AS (SELECT doc_id, para, sents, list_reduce(e, lambda a, x: CASE WHEN (a[-1].size < {X.LEAST_CHUNK} OR x[1].size < {X.LEAST_CHUNK}) AND a[-1].size + 1 + x[1].size <= {X.MOST_CHUNK}
  THEN list_concat(a[:-2], [struct_pack(f := a[-1].f, t := x[1].t, size := a[-1].size + 1 + x[1].size)]) ELSE list_concat(a, x) END) AS r FROM sized),
fr AS (SELECT doc_id, para, sents, unnest(r) AS x, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS n FROM fold)"""
_RECUT = f"""{_MASKS}, {_FOLD},
big AS (SELECT doc_id, para * 100000 + n AS para, unnest(sents[x.f + 1:x.t + 1]) AS text, generate_subscripts(sents[x.f + 1:x.t + 1], 1) - 1 AS sent FROM fr WHERE x.size > {X.MOST_CHUNK}),
{UNITS_SQL.replace('FROM sents)', 'FROM big)')}, {PIECES_SQL}, {CHUNK_FOLD_SQL},
cut AS (SELECT fr.doc_id, fr.para, fr.n AS g, generate_subscripts(c, 1) AS piece, unnest(c) AS c, fr.x FROM fr JOIN folded_chunks k ON k.doc_id = fr.doc_id AND k.para = fr.para * 100000 + fr.n),
every AS (SELECT doc_id, para, g, piece, CAST(c.s0 + x.f AS INTEGER) AS s0, CAST(c.s1 + x.f AS INTEGER) AS s1, c.text FROM cut
  UNION ALL SELECT doc_id, para, n, 1, x.f, x.t, array_to_string(sents[x.f + 1:x.t + 1], ' ') FROM fr WHERE x.size <= {X.MOST_CHUNK})"""
ORACLES = {
    "M1_prompt": f"""WITH {PARAS_SQL}, {SENTS_SQL}, p AS (SELECT doc_id, para, 'paragraph ' || para || ':' || chr(10) || string_agg(sent || ' (' || length(text) || ') ' || text, chr(10) ORDER BY sent) AS b FROM sents GROUP BY 1, 2)
SELECT doc_id, '{RULES}' || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY para) || chr(10) AS prompt FROM p GROUP BY 1""",
    "M2_M10_answers": """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '1' || length(text) WHEN turn % 4 = 1 THEN '}' || length(text) || '{' WHEN turn % 4 = 3 AND role = 'user' THEN '10' END AS mask,
  CAST(CASE WHEN turn % 4 = 2 THEN length(text) END AS INTEGER) AS "to" FROM conversations""",
    "M3_groups": f"WITH {_GROUPS}, x AS (SELECT doc_id, para, by_mask, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS n, unnest(g) AS g FROM groups) SELECT doc_id, para, by_mask, n, g.f AS s0, g.t AS s1 FROM x",
    "M4_valid": f"WITH {_VALID} SELECT * FROM valid",
    "M5_fold": f"WITH {_MASKS}, {_FOLD} SELECT doc_id, para, n, x.f AS s0, x.t AS s1, CAST(x.size AS INTEGER) AS size FROM fr",
    "M6_recut": f"WITH {_RECUT} SELECT doc_id, para, CAST(row_number() OVER (PARTITION BY doc_id, para ORDER BY g, piece) - 1 AS INTEGER) AS n, s0, s1, text FROM every",
    "M9_A9_report": f"""WITH {_VALID}, r AS (SELECT CASE WHEN by_mask = 0 THEN 'bad_json' ELSE 'bad_groups' END AS reason, count(*) AS n FROM valid WHERE NOT valid GROUP BY 1)
SELECT CASE WHEN count(*) FILTER (valid) > 0 THEN 'llm:stub' ELSE 'heuristic' END AS planner, count(*) FILTER (valid) AS by_model, count(*) FILTER (NOT valid) AS fallback,
  coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM r), '') AS reasons FROM valid""",
}
