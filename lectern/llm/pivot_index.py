"""Near duplicates of embeddings through a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, group_starts, known_by, of_groups, small_batches, sorted_groups, split_groups, stored

#: Least cosine of a link.
LINK = 0.95
#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 6, 2
#: Pivots count together only if their places in a vector's order, from 0, sum up to this at most: the far ones count beside near ones.
EARLY = 6
#: No two pivots have a larger cosine: a dense group of vectors has one pivot, not a share of them.
APART = 0.7


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(float)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, least: int = 64, most: int = 4096) -> dict[int, np.ndarray]:
    """Reference points for each length of vectors: a sample of the distinct ones by the hash of their bytes.

    About 4 times the square root of their number, between ``least`` and
    ``most``: a documented bound. Lists of pivot pairs then hold about as many
    vectors at every size up to a million vectors, and grow slowly beyond.
    """
    counts = {r[0]: r[1] for r in vectors.groupBy(F.size("v").alias("width")).count().collect()}
    want = {width: max(least, min(most, math.ceil(4 * math.sqrt(n)))) for width, n in counts.items()}
    if not want:
        return {}
    part = F.try_element_at(F.create_map(*(F.lit(x) for width, n in counts.items() for x in (width, min(1.0, 1.2 * want[width] / n)))), F.size("v"))
    sampled = vectors.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_003)) < part * 1_000_003).select("digest", "v")
    rows = sampled.limit(2 * most).collect() if len(counts) == 1 else sampled.collect()
    by_width: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: bytes(r["digest"])):
        by_width.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {}
    # A length of which the hash takes none: the one of least digest stands for all.
    missing = [width for width in counts if width not in by_width]
    if missing:
        for r in vectors.where(F.size("v").isin(missing)).groupBy(F.size("v").alias("width")).agg(F.min_by("v", "digest").alias("v")).collect():
            by_width[r["width"]] = [r["v"]]
    for width, given in by_width.items():
        chosen = np.zeros((0, width))
        for v in unit(np.array(given, float)):
            if len(chosen) < most and not (chosen @ v > APART).any():
                chosen = np.vstack((chosen, v))
        pivots[width] = chosen
    return pivots


def permutation_prefix(vectors: np.ndarray, pivots: np.ndarray, length: int = NEAREST) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots, nearest first."""
    length = min(length, len(pivots))
    out = np.empty((len(vectors), length), np.int64)
    for lo in range(0, len(vectors), 4096):
        near = vectors[lo : lo + 4096] @ pivots.T
        top = np.argpartition(-near, length - 1, axis=1)[:, :length]
        out[lo : lo + 4096] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def list_keys(prefix: np.ndarray, pivots: int, shared: int = SHARED, early: int = EARLY) -> np.ndarray:
    """Keys of the inverted lists of each vector, ascending in a row: one for every ``shared`` of its nearest pivots that stand early enough in its order.

    Two vectors meet in a list exactly if they share that many pivots that are
    early in both orders; each further shared pivot makes more meetings.
    """
    places = [p for p in combinations(range(prefix.shape[1]), min(shared, prefix.shape[1])) if sum(p) <= max(early, sum(range(shared)))]
    keys = np.zeros((len(prefix), len(places)), np.int64)
    for k, own in enumerate(places):
        chosen = np.sort(prefix[:, own], 1)  # a list knows its pivots, not their order
        for i in range(len(own)):
            keys[:, k] = keys[:, k] * (pivots + 1) + chosen[:, i] + 1
    return np.sort(keys, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, link: float = LINK, nearest: int = NEAREST, shared: int = SHARED, block: int = 1024) -> DataFrame:
    """One row per row of vectors (vec_id, embedding) with n_links, component_id and kept.

    Equal vectors form a class that is indexed once. A class is listed under
    every pair of its nearest pivots; classes of one list are compared in
    blocks by cosine in double precision, and a pair that meets in several
    lists is compared in the first of them only. What leaves a task is the
    number of links of each class and enough of them to hold its components
    together, never all pairs. Lists of any length are dealt in blocks of about
    ``block`` classes.

    A class is known by the digest of its components and has a number of its
    own, so vec_ids are never keys of a join: they may be null or stand several times.

    Edge cases: vectors that are null or empty, all zero, or hold null or
    non-finite components link with nothing, nor do two vectors of unlike lengths;
    such a row is its own component. Copies link with each other. There is one
    row for each row given: rows of equal vec_id have the links of their own
    vector each, but are one node of a component. A null vec_id is no node's:
    such a row is in its vector's component, whose id is the least vec_id that
    isn't null, or null. Other columns, labels too, are left out; an empty table stays empty.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # -0.0 equals 0.0: adding 0.0 makes them one.
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    clean = F.transform("v", lambda x: x + F.lit(0.0).cast(kind))
    keyed = rows.where("sound").select("vec_id", clean.alias("v")).withColumn("digest", F.unhex(F.md5(F.array_join(F.col("v").cast("array<string>"), ","))))
    grouped = keyed.groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()))
    found = stored(_links(classes, choose_pivots(classes), link, nearest, shared, block))
    ids = stored(keyed.select("digest", "vec_id").withColumn("row", F.monotonically_increasing_id()))
    # Classes that hold one vec_id are one node: each is joined with the first of them.
    holders = known_by(ids.where("vec_id IS NOT NULL"), "digest", classes.select("digest", "class"), "row").select("vec_id", "class").distinct()
    one_node = of_groups(holders, "vec_id", "class", "class").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    joined = components(found.where("b IS NOT NULL").select("a", "b").union(one_node)).withColumnRenamed("id", "class")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    placed = classes.select("digest", "class", "copies", "least_id").join(joined, "class", "left").join(counts, "class", "left")
    placed = placed.select("digest", "class", "least_id", F.coalesce("component", "class").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = of_groups(placed, "component", "least_id", "class").select("digest", "n_links", F.col("least").alias("component_id"))
    linked = known_by(ids, "digest", named, "row").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, pivots: dict[int, np.ndarray], link: float, nearest: int, shared: int, block: int) -> DataFrame:
    """Rows (a, n, null): n links of class a found in some block; rows (a, null, b): links that join what a block links."""
    spark, kind = classes.sparkSession, classes.schema["v"].dataType.simpleString()
    known = spark.sparkContext.broadcast(pivots)  # at most ``most`` vectors of each length

    ranks = {width: i for i, width in enumerate(sorted(pivots))}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["v"].offsets.to_numpy())
            for width in np.unique(sizes).tolist():
                some, own = batch.take(pa.array(np.flatnonzero(sizes == width))), known.value[width]
                # Vectors of unlike lengths have no list in common.
                keys = list_keys(permutation_prefix(unit(_matrix(some["v"])), own, nearest), len(own), shared) * len(known.value) + ranks[width]
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                yield pa.record_batch([some["class"], some["copies"], some["v"], pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["class", "copies", "v", "keys"])

    index = classes.select("class", "copies", "v").mapInArrow(listed, f"class long, copies long, v {kind}, keys array<long>")
    index = stored(index)
    # Lists are dealt to blocks as pairs (key, class); vectors follow only to the places that are left.
    dealt = split_groups(index.select(F.explode("keys").alias("key"), "class"), "key", "class", block).join(index, "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _of_one_length(sorted_groups(batches, ["key", "bi", "bj"], 2 * block)):
            starts = np.append(group_starts(table, ["key", "bi", "bj"]), table.num_rows)
            ids, copies, keys = table["class"].to_numpy(), table["copies"].to_numpy(), _matrix(table["keys"])
            vectors, side, own_key = unit(_matrix(table["v"])), table["side"].to_numpy(), table["key"].to_numpy()
            bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
            out_a, out_n, out_b = [], [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                mine = np.arange(lo, hi)
                same = bi[lo] == bj[lo]
                left, right = (mine, mine) if same else (mine[side[lo:hi] == 0], mine[side[lo:hi] == 1])
                i, j = np.nonzero(vectors[left] @ vectors[right].T >= link)
                i, j = left[i], right[j]
                once = ids[i] < ids[j] if same else ids[i] != ids[j]
                i, j = i[once], j[once]
                for part in range(0, len(i), 100_000):
                    a, b = i[part : part + 100_000], j[part : part + 100_000]
                    # The first list that both are in: the least common key.
                    common = (keys[a][:, :, None] == keys[b][:, None, :]).any(2)
                    first = np.where(common, keys[a], np.iinfo(np.int64).max).min(1) == own_key[lo]
                    a, b = a[first], b[first]
                    counts = np.bincount(a - lo, copies[b], hi - lo) + np.bincount(b - lo, copies[a], hi - lo)
                    some = np.flatnonzero(counts)
                    out_a.append(ids[lo + some])
                    out_n.append(counts[some].astype(np.int64))
                    out_b.append(np.full(len(some), -1))
                    for x, y in _forest(a, b):
                        out_a.append(ids[[x]])
                        out_n.append(np.zeros(1, np.int64))
                        out_b.append(ids[[y]])
            if out_a:
                a, n, b = np.concatenate(out_a), np.concatenate(out_n), np.concatenate(out_b)
                yield from pa.table([pa.array(a), pa.array(n), pa.array(b, mask=n > 0)], ["a", "n", "b"]).to_batches(50_000)

    narrow = dealt.select("key", "bi", "bj", "side", "class", "copies", "keys", "v")
    grouped = narrow.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return grouped.mapInArrow(compare, "a long, n long, b long")


def _of_one_length(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Tables parted by the length of their vectors; a list has vectors of one length only."""
    for table in tables:
        table = table.combine_chunks()
        sizes = pc.list_value_length(table["v"]).to_numpy()
        for width in np.unique(sizes):
            yield table if sizes[0] == width and (sizes == width).all() else table.filter(pa.array(sizes == width)).combine_chunks()


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those links that join two groups not joined by an earlier one."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        s, t = top(x), top(y)
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((x, y))
    return out
