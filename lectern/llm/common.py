"""What the operators share: durable intermediate tables, row streams by key, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import stored

#: Bytes of white space that part words, as in ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once: texts may be long, and Spark's own bound counts rows only.

    Settings that the user has made stay as they are.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def passing(*usual: str):
    """For operators over a table whose result keeps the table's columns: all but the ``usual`` ones, and those that an argument names, travel packed in one column.

    So names that an operator makes for itself never meet a user's. Columns come
    back in their order, then the operator's; one of a result's name is replaced.
    """
    def wrap(operator):
        @wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            named = {*usual, *(a for a in (*args, *options.values()) if isinstance(a, str))}
            others = [c for c in df.columns if c not in named]
            if not others:
                return operator(df, *args, **options)
            stay = [c for c in df.columns if c in named]
            out = operator(df.select(*stay, F.struct(*(F.col(f"`{c}`") for c in others)).alias("other_columns")), *args, **options)
            new = [c for c in out.columns if c not in stay and c != "other_columns"]
            left = [c for c in df.columns if c not in new and (c in others or c in out.columns)]
            return out.select(*(F.col(c) if c in stay else F.col("other_columns").getField(c).alias(c) for c in left), *new)

        return run

    return wrap


def crc32_mod4(doc_id) -> F.Column:
    """crc32 of the id's text modulo 4; the remainder 2 is held out of all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


# -- rows of Arrow batches, grouped by a sorted key ---------------------------------


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys.

    A table holds as many groups as came in about most_rows rows, so that work
    on many small groups can be done at once. Groups must be bounded by the
    caller (see split_groups).
    """
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(waiting)
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        waiting, rows = rest.to_batches(), rest.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the UTF-8 bytes of a string column and their offsets from 0: up to ``most`` bytes, or one longer text.

    Null texts have no bytes.
    """
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    content = texts.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(texts))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_groups(df: DataFrame, key: str, row: str, most: int, unlike: str | None = None) -> DataFrame:
    """Rows of keys held by two rows or more, dealt into pairs of blocks of about ``most`` rows.

    Adds ``bi <= bj`` and ``side`` (0: the row is of block bi, 1: of block bj).
    Every two rows of a key meet in exactly one (key, bi, bj). A key of n rows
    has ceil(n / most) blocks, and a row is repeated once for each block of its
    key, so no task ever gets a whole hot key. ``row`` names the column whose
    hash deals rows to blocks. With ``unlike``, a column, keys all of whose rows
    are equal in it are left out.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *((F.min(unlike).alias("_u"), F.max(unlike).alias("_v")) if unlike else ())).where("_n > 1" + (" AND _u <> _v" if unlike else ""))
    sized = sizes.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_nb"))
    with_n = df.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(16))).join(
        sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>"))), [key, "_salt"]
    )
    own = F.pmod(F.xxhash64(F.col(row), F.lit(7)), F.col("_nb")).cast("int")
    return (
        with_n.withColumn("_b", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("bi", F.least("_b", "_o"))
        .withColumn("bj", F.greatest("_b", "_o"))
        .withColumn("side", (F.col("_b") > F.col("_o")).cast("int"))
        .drop("_salt", "_nb", "_b", "_o")
    )


def of_groups(rows: DataFrame, key: str, value: str, deal: str, salts: int = 256) -> DataFrame:
    """rows with group_size (rows of equal key) and least (their least value); key isn't null.

    Counts and minima are taken for each (key, salt) first, where the hash of
    column ``deal`` chooses one of ``salts``, and go back to rows the same way: a
    task gets a part of a hot key's rows, and there are never more (key, salt) pairs than rows.
    """
    salt = F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int")
    parts = rows.groupBy(key, salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_v"))
    whole = parts.groupBy(key).agg(F.sum("_n").alias("group_size"), F.min("_v").alias("least")).where("group_size > 1")
    known = parts.select(key, "_salt").join(whole, key)
    found = rows.withColumn("_salt", salt).join(known, [key, "_salt"], "left").drop("_salt")
    return found.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).withColumn("least", F.coalesce("least", F.col(value)))


def known_by(rows: DataFrame, key: str, info: DataFrame, deal: str, salts: int = 64) -> DataFrame:
    """rows with the columns of info (one row for each key); rows of a key are dealt to ``salts`` tasks by the hash of ``deal``, and info goes only where they are."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    where = salted.select(key, "_salt").distinct().join(info, key)
    return salted.join(where, [key, "_salt"]).drop("_salt")


# -- connected components ----------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id reaches over undirected edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al. 2014); every
    step is a shuffle of the edges by one end, and every second one is written
    to the shared folder. Ids without an edge don't appear. A node's neighbours
    are never gathered: each step takes a minimum per node and joins it back.
    Raises RuntimeError if ``rounds`` don't suffice; they are logarithmic in the longest path.
    """
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while not _are_stars(now):
        if not rounds:
            raise RuntimeError("components haven't settled")
        rounds -= 1
        # Large star: every larger neighbour of u is linked to the smallest of u's neighbourhood.
        both = now.select(_both_ways("u", "v", "v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _salted(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, low).select(_both_ways("v", "m", "u", "m"))
        now = stored(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _both_ways(a: str, b: str, c: str, d: str) -> F.Column:
    """Two rows (u, v) of each: (a, b) and (c, d)."""
    return F.inline(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(c).alias("u"), F.col(d).alias("v"))))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node with one edge to a node from which none leads."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def _salted(pairs: DataFrame, low: DataFrame, parts: int = 32) -> DataFrame:
    """pairs (u, v) with the minimum m of u; the pairs of one u are dealt to ``parts`` tasks."""
    return pairs.withColumn("_s", F.pmod(F.hash("v"), F.lit(parts))).join(
        low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["u", "_s"]
    ).select("u", "v", "m")
