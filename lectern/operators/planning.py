"""What a planning model answers, as data: prompts out, break masks in, checked groups and chunks.

Sentences of a paragraph stay in one array, so masks, groups and chunks are
worked out inside a row; only checking a whole document shuffles, by document.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as X

GROUPS = "array<struct<from:int,to:int,size:int>>"
#: Strings of a JSON text, closed or not, and braces outside them.
TOKENS = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.DOTALL)
THOUGHTS = re.compile(r"<think>.*?</think>", re.DOTALL)


# -- prompts and answers --------------------------------------------------------------------


def prompts(sents: DataFrame, rules: str = "") -> DataFrame:
    """(doc_id, prompt): rules, then each paragraph's sentences numbered with their lengths.

    sents: doc_id, para, sent, text. Paragraphs that aren't spoken must be left out by the caller.
    """
    plain = F.translate("text", "\n", " ")
    line = F.concat(F.col("sent").cast("string"), F.lit(" ("), F.length(plain).cast("string"), F.lit(") "), plain)
    in_order = lambda of: F.transform(F.array_sort(F.collect_list(of)), lambda x: x["l"])
    paras = sents.groupBy("doc_id", "para").agg(F.array_join(in_order(F.struct("sent", line.alias("l"))), "\n").alias("body"))
    whole = F.concat(F.lit("paragraph "), F.col("para").cast("string"), F.lit(":\n"), "body")
    docs = paras.groupBy("doc_id").agg(F.array_join(in_order(F.struct("para", whole.alias("l"))), "\n\n").alias("body"))
    return docs.select("doc_id", F.concat(F.regexp_replace(F.concat(F.lit(rules + "\n"), "body"), r"\s+$", ""), F.lit("\n")).alias("prompt"))


def answer_text(content: Column, reasoning: Column) -> Column:
    """An answer's content, else its reasoning, each if it isn't blank; null where both are."""
    filled = lambda c: F.when(c.rlike(r"\S"), c)
    return F.coalesce(filled(content), filled(reasoning))


def last_object(text: str | None) -> str | None:
    """The JSON object that a text is, else the last one among its outermost braces; without thoughts. Braces in strings don't count."""
    if text is None:
        return None
    body = THOUGHTS.sub("", text.strip()).strip()
    spans, depth, start = [body], 0, 0
    for token in TOKENS.finditer(body):
        if token[0] == "{":
            start = token.start() if not depth else start
            depth += 1
        elif token[0] == "}" and depth:
            depth -= 1
            if not depth:
                spans.append(body[start : token.end()])
    for span in (spans[0], *reversed(spans[1:])):
        try:
            found = json.loads(span)
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """last_object of each text."""
    return text.map(last_object)


def breaks_of(answer: Column) -> Column:
    """Masks by paragraph key of an answer's JSON text; null where it has none."""
    return F.from_json(answer, "breaks map<string,string>")["breaks"]


def legacy_groups(answer: Column) -> Column:
    """Groups (para, from, to) of the older shape of answers; null where it has none."""
    return F.from_json(answer, "groups array<struct<para:int,from:int,to:int>>")["groups"]


# -- masks to groups -----------------------------------------------------------------------


def usable(mask: Column, n: Column) -> Column:
    """Whether a mask is a mask: not empty, for some sentences, and at least nine in ten characters binary."""
    return F.coalesce((n > 0) & (F.length(mask) > 0) & (F.regexp_count(mask, F.lit("[01]")) / F.length(mask) >= 0.9), F.lit(False))


def repaired(mask: Column, n: Column) -> Column:
    """A usable mask with other digits as 0, cut or filled up to n, and a 1 in front."""
    return F.concat(F.lit("1"), F.substring(F.rpad(F.regexp_replace(mask, "[^01]", "0"), n, "0"), F.lit(2), n - 1))


def groups_of_mask(mask: Column, n: Column) -> Column:
    """array<struct<from,to>> of a repaired mask: a group begins at each 1."""
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(mask, i + 1, F.lit(1)) == "1")
    pair = lambda s: F.transform(s, lambda x, i: F.struct(x.cast("int").alias("from"), (F.coalesce(F.get(s, i + 1), n) - 1).cast("int").alias("to")))
    return F.transform(F.array(starts), pair)[0]


def grouped(paras: DataFrame) -> DataFrame:
    """paras (doc_id, para, sents, mask) with by_mask and groups: those of the mask, else those of the packing rule."""
    n = F.size("sents")
    packed = F.transform(X.chunks(X.units(F.col("sents"))), lambda c: F.struct(c["s0"].alias("from"), c["s1"].alias("to")))
    made = paras.withColumn("by_mask", usable(F.col("mask"), n))
    groups = F.when(F.col("by_mask"), groups_of_mask(repaired(F.col("mask"), n), n)).when(n > 0, packed).otherwise(F.array().cast("array<struct<from:int,to:int>>"))
    return X.settled(made, *(c for c in made.columns if c != "groups"), value=groups, name="groups")


def covers(groups: Column, n: Column) -> Column:
    """Whether groups, in order, cover sentences 0 to n - 1 without gap or overlap."""
    def cover(s: Column) -> Column:
        follows = F.forall(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["from"] == F.when(i == 0, 0).otherwise(F.get(s, i - 1)["to"] + 1))
        sound = F.forall(s, lambda g: (g["from"] >= 0) & (g["from"] <= g["to"]) & (g["to"] < n))
        return (F.size(s) > 0) & sound & follows & (F.element_at(s, F.greatest(F.size(s), F.lit(1)))["to"] == n - 1)

    # Sorted once a row, not once for each group.
    return F.coalesce(F.transform(F.array(F.array_sort(groups)), cover)[0], F.lit(False))


def checked(paras: DataFrame) -> DataFrame:
    """(doc_id, paras, by_mask, valid): documents whose every paragraph with sentences is covered exactly, and which have a mask at all."""
    spoken = paras.where(F.size("sents") > 0)
    return spoken.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paras"), F.count_if("by_mask").alias("by_mask"), (F.bool_or("by_mask") & F.bool_and(covers(F.col("groups"), F.size("sents")))).alias("valid"))


# -- groups to chunks -------------------------------------------------------------------------


def folded(groups: Column, sents: Column, least: int = X.LEAST_CHUNK, most: int = X.MOST_CHUNK) -> Column:
    """Groups with their sizes, where one below ``least`` characters has joined the one before it, else the one after, if both have ``most`` at most.

    One pass suffices: a group that couldn't be joined with its neighbours can't once those have grown.
    """
    def size(g: Column) -> Column:
        return F.aggregate(F.slice(sents, g["from"] + 1, g["to"] - g["from"] + 1), F.lit(-1), lambda a, s: a + 1 + F.length(s))

    sized = F.transform(groups, lambda g: F.array(F.struct(g["from"].alias("from"), g["to"].alias("to"), size(g).alias("size"))).cast(GROUPS))

    def step(done: Column, g: Column) -> Column:
        last, new = F.try_element_at(done, F.lit(-1)), g[0]
        together = last["size"] + 1 + new["size"]
        joins = (F.size(done) > 0) & ((last["size"] < least) | (new["size"] < least)) & (together <= most)
        both = F.array(F.struct(last["from"].alias("from"), new["to"].alias("to"), together.alias("size"))).cast(GROUPS)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), both)).otherwise(F.concat(done, g))

    return F.aggregate(sized, F.array().cast(GROUPS), step)


def chunks_of_groups(paras: DataFrame) -> DataFrame:
    """(doc_id, para, n, s0, s1, text): folded groups as chunks; one that is too long is cut by the packing rule.

    paras: doc_id, para, sents, groups.
    """
    flat = X.each(paras, "doc_id", "para", "sents", value=folded(F.array_sort("groups"), F.col("sents")), names=("g", "f"))
    own = F.slice("sents", F.col("f.from") + 1, F.col("f.to") - F.col("f.from") + 1)
    kind = "array<struct<s0:int,s1:int,text:string>>"
    recut = F.transform(X.chunks(X.units(own)), lambda c: F.struct((c["s0"] + F.col("f.from")).alias("s0"), (c["s1"] + F.col("f.from")).alias("s1"), c["text"].alias("text"))).cast(kind)
    whole = F.array(F.struct(F.col("f.from").alias("s0"), F.col("f.to").alias("s1"), F.array_join(own, " ").alias("text"))).cast(kind)
    cut = X.each(flat, "doc_id", "para", "g", value=F.when(F.col("f.size") > X.MOST_CHUNK, recut).otherwise(whole), names=("piece", "c"))
    order = Window.partitionBy("doc_id", "para").orderBy("g", "piece")
    return cut.select("doc_id", "para", (F.row_number().over(order) - 1).alias("n"), "c.*")


def planner_report(docs: DataFrame, model: str) -> DataFrame:
    """One row: planner stamp, documents planned by the model and otherwise, and the reasons as JSON.

    docs: doc_id, used (boolean), reason (null where the model was used).
    """
    kinds = docs.groupBy("used", "reason").agg(F.count(F.lit(1)).alias("n"))  # documents are worked out once
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    why = F.collect_list(F.when(~F.col("used") & F.col("reason").isNotNull(), F.struct("reason", "n")))
    listed = F.array_join(F.transform(F.array_sort(why), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ",")
    counts = kinds.agg(total(F.col("used")).alias("by_model"), total(~F.col("used")).alias("fallback"), listed.alias("reasons"))
    stamp = F.when(F.col("by_model") > 0, F.lit(f"llm:{model}")).otherwise("heuristic")
    return counts.select(stamp.alias("planner"), "by_model", "fallback", "reasons")
