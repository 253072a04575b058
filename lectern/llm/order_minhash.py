"""Near duplicates by Order MinHash: minima of occurrence-labelled shingles, kept in text order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import components, group_starts, passing, small_batches, sorted_groups, split_groups, stored
from lectern.llm.words import M1, mix, shingle_hashes, word_hashes, word_spans

#: Words of a shingle, elements of a sketch, and shingles of an element.
SIZE, ELEMENTS, LENGTH = 5, 12, 2
#: Further elements, for pairs that the sketch alone would miss: with a fifth of the words changed an element agrees in one of 23 cases.
FURTHER = 60
SIMILAR = 0.8
#: Partners that a text is first aligned with in a list: those that agree most, and the most central ones of the list.
FIRST, CENTRAL = 4, 2
#: Elements of two sketches that must agree where the two aren't each other's nearest in a list.
AGREE = 2
BLOCK = 1024
#: Bits of the sketch that bounds how alike two texts can be.
ODD_BITS = 1024
#: Places of a block on either side of a tile, whose pairs are aligned by one task.
TILE = 128
TILE_SCHEMA = "list long, bi int, bj int, ti int, tj int, nth int, key binary, partners array<int>"


def text_words(data: bytes) -> np.ndarray:
    array = np.frombuffer(data, np.uint8)
    return word_hashes(array, *word_spans(array))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of shingles or words with their occurrence number: the n-th time that one stands in the text."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order]
    first = np.concatenate(([True], same[1:] != same[:-1]))
    at = np.arange(len(same))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(shingles)
    out[order] = mix(same + nth.astype(np.uint64) * M1)
    return out


def sketch(shingles: np.ndarray, elements: int = ELEMENTS, length: int = LENGTH) -> np.ndarray:
    """One hash per element: of the ``length`` shingles that are least under the element's own hash, in text order."""
    marked = labelled(shingles)
    n = min(length, len(marked))
    seeds = mix(np.arange(1, elements + 1, dtype=np.uint64))
    at = np.empty((elements, n), np.int64)
    step = max(1, 1_200_000 // len(marked))
    for lo in range(0, elements, step):
        x = (marked[None, :] ^ seeds[lo : lo + step, None]) * M1
        x ^= x >> np.uint64(32)
        for i in range(n):
            at[lo : lo + step, i] = x.argmin(1)
            np.put_along_axis(x, at[lo : lo + step, i : i + 1], np.iinfo(np.uint64).max, 1)
    at.sort(axis=1)
    h = seeds.copy()
    for i in range(n):
        h = mix(h * M1 + marked[at[:, i]])
    return h


def odd_sketch(words: np.ndarray, bits: int = ODD_BITS) -> np.ndarray:
    """Parity of the number of labelled words in each of ``bits`` bins, packed (Mitzenmacher et al. 2014).

    Two texts differ in at least as many words as their sketches differ in bits.
    """
    return np.packbits(np.bincount(labelled(words) >> np.uint64(64 - bits.bit_length() + 1), minlength=bits).astype(np.uint8) & 1)


def aligned_length(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence over matches at most ``band`` places apart, by bit-parallel rows.

    A row's bits are the places of b; places outside the band never match.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for i, x in enumerate(a):
        match = places.get(x)
        if match is None:
            continue
        match &= (window << (i - band)) if i >= band else window >> (band - i)
        u = row & match
        row = ((row + u) | (row - u)) & full
    return head + tail + len(b) - row.bit_count()


def similarity(a: list[int], b: list[int], least: float = SIMILAR) -> float:
    """Edit similarity of two texts' words: words aligned in order over those of the longer text; 0 if surely below ``least``.

    A pair of at least ``least`` has few words that aren't aligned, and these
    bound the band. A pair whose five-word shingles have a resemblance of
    ``least`` or more has at least this edit similarity.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    spare = int(max(n, m) * (1 - least)) + 1
    return aligned_length(a, b, spare) / max(n, m)


def packed_texts(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(key, z, copies, first_id): each distinct text once, compressed, under its 16-byte md5, with its least id."""
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col(ident).alias("id"))
    kind = texts.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch["key"], pa.array([squeeze.compress(t.as_buffer()) for t in batch["text"]], pa.binary()), batch["id"]], ["key", "z", "id"])

    made = texts.mapInArrow(pack, f"key binary, z binary, id {kind}")
    return made.groupBy("key").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))


def nearest(agree: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's partners: the ``most`` with which most elements agree."""
    np.fill_diagonal(agree, -1)
    top = np.argsort(-agree, axis=1, kind="stable")[:, :most]
    i = np.repeat(np.arange(len(agree)), top.shape[1])
    j = top.ravel()
    there = agree[i, j] > 0
    return i[there], j[there]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@passing("doc_id", "text")
def near_duplicates(docs: DataFrame, similar: float = SIMILAR, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text, more) with class_id, kept and n_links.

    Two texts are linked if they share sketch elements of five-word shingles and
    their words, aligned in order, have an edit similarity of ``similar`` or more
    (see similarity). Of pairs whose similarity is just ``similar`` and whose words
    are changed one by one, more than nine in ten share one. class_id is the least doc_id of
    the texts joined by links; kept marks the rows that bear it; n_links counts
    the verified links of the row's text to other texts. A class_id may be that
    of several classes, if unlike texts bear one doc_id or none; one_of_each
    keeps them apart.

    Each distinct text is sketched once. Texts that share an element of their
    sketches meet in a list; long lists are dealt in pairs of blocks. First a
    text is aligned only with the texts of its lists that agree with it in most
    elements and with the most central ones: a number of pairs linear in the
    list, which joins the bulk of every class. Then every other pair of a list
    that agrees in AGREE elements and isn't in one class yet is aligned too. In
    the lists of FURTHER elements each class found so far has one text, the one
    of least key that bears the element, and all pairs of a list are aligned
    whose lengths and odd sketches allow the similarity. So classes are those of
    all such pairs; pairs inside a class that is already joined are left out
    (n_links counts the links that were verified).

    Edge cases: null texts count as empty; texts without a word are alike only if
    equal; a text below five words is one shingle; rows of equal text are one
    class; a null doc_id is greater than any other and may be a class_id only
    among null ids; other columns pass through, but the names added here are
    replaced; an empty table stays empty.
    """
    docs = docs.drop("class_id", "kept", "n_links")
    return _classed(docs, similar, size).select(*docs.columns, "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_links")


@passing("doc_id", "text")
def one_of_each(docs: DataFrame, similar: float = SIMILAR, size: int = SIZE) -> DataFrame:
    """docs with one row of each class of near_duplicates: a row of least doc_id (of several such texts that of least md5; of equal rows any).

    Columns and edge cases are those of near_duplicates; unlike texts that bear
    one doc_id or none stay apart. Only rows of a text with copies are shuffled again, two for each of 16 parts at most.
    """
    names = docs.columns
    found = _classed(docs, similar, size).where(F.col("_leads") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    alone, several = found.where("_copies = 1"), found.where("_copies > 1")
    for part in (["_key", "_s"], ["_key"]):
        several = several.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy("_s"))).where("_n = 1").drop("_n")
    return alone.select(*names).union(several.select(*names))


def _classed(docs: DataFrame, similar: float, size: int) -> DataFrame:
    """docs with class_id, n_links, _copies (rows of the text), _leads (whether the text is the first of its class), _key and a part number _s."""
    small_batches(docs.sparkSession)
    texts = stored(packed_texts(docs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, counts, values, more, odd = [], [], [], [], []
            for key, z in zip(batch["key"].to_pylist(), batch["z"].to_pylist()):
                words = text_words(expand.decompress(z))
                if len(words):
                    keys.append(key)
                    counts.append(len(words))
                    whole = sketch(shingle_hashes(words, size), ELEMENTS + FURTHER).view(np.int64)
                    values.append(whole[:ELEMENTS])
                    more.append(whole[ELEMENTS:])
                    odd.append(odd_sketch(words).tobytes())
            if keys:
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, e * len(keys) + 1, e, dtype=np.int32)), pa.array(np.concatenate(v))) for e, v in ((ELEMENTS, values), (FURTHER, more))]
                yield from pa.table([pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), *lists, pa.array(odd, pa.binary())], ["key", "n", "sketch", "further", "odd"]).to_batches(20_000)

    sketches = stored(texts.select("key", "z").mapInArrow(make, "key binary, n int, sketch array<long>, further array<long>, odd binary"))
    links = stored(_aligned(_first_pairs(sketches, similar), texts, similar).where("similar").select("a", "b"))
    classes = stored(sketches.join(components(links).withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    late = stored(_aligned_tiles(_other_tiles(classes, similar).withColumn("kind", F.lit(0)).union(_further_tiles(classes, similar).withColumn("kind", F.lit(1))), texts, similar))
    of_key = classes.select("key", "component")
    between = late.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").distinct().join(of_key.select(F.col("key").alias("a"), F.col("component").alias("u")), "a").join(of_key.select(F.col("key").alias("b"), F.col("component").alias("v")), "b")
    merged = components(between.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("_last"))
    joined = of_key.join(merged, "component", "left").select(F.col("key").alias("id"), F.coalesce("_last", "component").alias("component"))
    one = F.lit(1).alias("links")
    degree = links.select(F.col("a").alias("key"), one).union(links.select(F.col("b").alias("key"), one)).union(late.select("key", "links")).groupBy("key").agg(F.sum("links").alias("n_links"))
    nodes = joined.join(texts.select(F.col("key").alias("id"), "first_id"), "id")
    ids = nodes.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("id", F.struct(F.col("first_id").isNull(), "first_id", "id")).alias("lead"))
    of_text = texts.select("key", "first_id", "copies").join(joined.withColumnRenamed("id", "key"), "key", "left").join(ids, "component", "left").join(degree, "key", "left")
    of_text = of_text.select(F.col("key").alias("_key"), F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                             F.col("copies").alias("_copies"), (F.coalesce("lead", "key") == F.col("key")).alias("_leads"))
    # A text with very many copies is one row there: it goes to all of its copies' parts.
    spread = of_text.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    return keyed.join(spread, ["_key", "_s"], "left")


def _lists(rows: DataFrame, *more: str, unlike: str | None = None) -> DataFrame:
    """rows (key, n, sketch, more) in the blocks of their inverted lists, sorted by list, block and key.

    Lists are dealt to blocks as pairs (list, key); sketches follow only to the places that are left.
    """
    narrow = rows.select(F.explode("sketch").alias("list"), "key", *([unlike] if unlike else []))
    dealt = split_groups(narrow, "list", "key", BLOCK, unlike).select("list", "bi", "bj", "side", "key")
    return dealt.join(rows.select("key", "n", "sketch", *more), "key").repartition("list", "bi", "bj").sortWithinPartitions("list", "bi", "bj", "key").select("list", "bi", "bj", "side", "key", "n", "sketch", *more)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, list[tuple[int, int, np.ndarray]]]]:
    """Tables of whole blocks with their sketches, and (start, end, agreeing elements of each two rows) of each block."""
    for table in sorted_groups(batches, ["list", "bi", "bj"], 20_000):
        table = table.combine_chunks()
        starts = np.append(group_starts(table, ["list", "bi", "bj"]), table.num_rows).tolist()
        marks, crossed, side = _matrix(table["sketch"].combine_chunks()), table["bi"].to_numpy() != table["bj"].to_numpy(), table["side"].to_numpy()

        def agreeing(lo: int, hi: int) -> np.ndarray:
            own = marks[lo:hi]
            agree = np.zeros((hi - lo, hi - lo), np.int16)
            for e in range(own.shape[1]):
                agree += own[:, e][:, None] == own[:, e][None, :]
            if crossed[lo]:
                agree[side[lo:hi][:, None] == side[lo:hi][None, :]] = 0
            return agree

        yield table, marks, ((lo, hi, agreeing(lo, hi)) for lo, hi in zip(starts[:-1], starts[1:]))


def _grouped(keys: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of row numbers (a ascending) as rows of a key and its partners."""
    firsts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    offsets = pa.array(np.append(firsts, len(a)).astype(np.int32))
    partners = pa.ListArray.from_arrays(offsets, keys.take(pa.array(b)).combine_chunks())
    yield from pa.table([keys.take(pa.array(a[firsts])), partners], ["a", "bs"]).to_batches(20_000)


def _first_pairs(sketches: DataFrame, similar: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each text with its nearest and the central texts of its lists."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, blocks in _blocks(batches):
            sizes, left, right = table["n"].to_numpy(), [], []
            for lo, hi, agree in blocks:
                middle = np.argsort(-agree.sum(1, dtype=np.int64), kind="stable")[:CENTRAL]
                i, j = nearest(agree, FIRST)
                i = lo + np.concatenate((i, np.tile(np.arange(hi - lo), len(middle))))
                j = lo + np.concatenate((j, np.repeat(middle, hi - lo)))
                fits = (i != j) & (np.minimum(sizes[i], sizes[j]) >= similar * np.maximum(sizes[i], sizes[j]))
                left.append(i[fits])
                right.append(j[fits])
            i, j = np.concatenate(left), np.concatenate(right)
            if len(i):
                both = np.unique(np.stack((np.minimum(i, j), np.maximum(i, j))), axis=1)
                yield from _grouped(table["key"], *both)

    listed = _lists(sketches).mapInArrow(choose, "a binary, bs array<binary>")
    # A text meets the same partners in many lists: they are made one before pairs are formed.
    # Rows of a list stand in the order of their keys: a < b.
    return listed.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")).select("a", F.explode("bs").alias("b"))


def _tiles(table: pa.Table, starts: list[int], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of row numbers (i, j) of the blocks that begin at ``starts`` as rows of TILE_SCHEMA: one for each text of each tile.

    A tile holds pairs of TILE by TILE places of a block. A text's row has the
    places, within the block, of its partners behind it there. So a block has at most
    as many rows as its texts have tiles, however many of its pairs are asked for.
    """
    if not len(i):
        return
    firsts = np.array(starts)
    block = np.searchsorted(firsts, i, "right") - 1
    x, y = i - firsts[block], j - firsts[block]
    order = np.lexsort((y, x, y // TILE, x // TILE, block))
    i, j, block, x, y = i[order], j[order], block[order], x[order], y[order]
    tile = np.stack((block, x // TILE, y // TILE))
    number = np.cumsum(np.concatenate(([True], (tile[:, 1:] != tile[:, :-1]).any(0)))) - 1
    # One row for each (tile, text): those of the left side with their partners, others without.
    left = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (x[1:] != x[:-1]))))
    wide = number << 32
    there, at = np.unique(np.concatenate(((wide + x)[left], wide + y)), return_index=True)
    row, nth = np.concatenate((i[left], j))[at], there & 0xFFFFFFFF
    counts = np.where(at < len(left), np.diff(np.append(left, len(x)))[np.minimum(at, len(left) - 1)], 0)
    # Left rows come in the order of the pairs, so their partners do too.
    partners = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(y.astype(np.int32)))
    rows = table.select(["list", "bi", "bj", "key"]).take(pa.array(row)).combine_chunks()
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    ti, tj = ((v[first] // TILE)[there >> 32].astype(np.int32) for v in (x, y))
    columns = [rows["list"], rows["bi"], rows["bj"], pa.array(ti), pa.array(tj), pa.array(nth.astype(np.int32)), rows["key"], partners]
    yield from pa.table(columns, ["list", "bi", "bj", "ti", "tj", "nth", "key", "partners"]).to_batches(20_000)


def _other_tiles(classes: DataFrame, similar: float) -> DataFrame:
    """Pairs of different components that agree in AGREE elements, each from the first list that both are in, as rows of tiles (see _tiles).

    Pairs whose odd sketches show that they differ in too many words are left out.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks, blocks in _blocks(batches):
            sizes, names = table["n"].to_numpy(), table["list"].to_numpy()
            odd = np.frombuffer(b"".join(table["odd"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
            of = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts, left, right = [], [], []
            for lo, hi, agree in blocks:
                i, j = np.nonzero(np.triu((agree >= AGREE) & (of[lo:hi, None] != of[None, lo:hi]), 1))
                i, j = lo + i, lo + j
                fits = np.minimum(sizes[i], sizes[j]) >= similar * np.maximum(sizes[i], sizes[j])
                i, j = i[fits], j[fits]
                first = np.empty(len(i), bool)
                for at in range(0, len(i), 100_000):
                    some = slice(at, at + 100_000)
                    x, y = marks[i[some]], marks[j[some]]
                    differing = np.bitwise_count(odd[i[some]] ^ odd[j[some]]).sum(1, dtype=np.int64)
                    near = differing <= sizes[i[some]] + sizes[j[some]] - 2 * similar * np.maximum(sizes[i[some]], sizes[j[some]]) + 1e-6
                    first[some] = near & (x[np.arange(len(x)), (x == y).argmax(1)] == names[lo])
                left.append(i[first])
                right.append(j[first])
                starts.append(lo)
            yield from _tiles(table, starts, np.concatenate(left), np.concatenate(right))

    # Only lists with texts of several classes have pairs left.
    return _lists(classes, "component", "odd", unlike="component").mapInArrow(choose, TILE_SCHEMA)


def _further_tiles(classes: DataFrame, similar: float) -> DataFrame:
    """Pairs of different components that share a further element, as rows of tiles (see _tiles): in its list each component has one text.

    A pair is given once, by the first list that holds both texts. Pairs whose
    lengths or odd sketches show that they differ in too many words are left out,
    and those that _other_tiles gives.
    """
    narrow = classes.select(F.posexplode("further").alias("element", "list"), "key", "component")
    # Most lists hold one text, or one class: only hashes are shuffled to leave them out.
    kind = F.xxhash64("component")
    mixed = narrow.groupBy("list").agg(F.min(kind).alias("u"), F.max(kind).alias("v")).where("u <> v").select("list", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    shared = narrow.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(mixed, ["list", "_salt"])
    one = stored(shared.groupBy("list", "component").agg(F.min("key").alias("key"), F.first("element").alias("element")).select("list", "element", "key"))
    held = one.groupBy("key").agg(F.collect_list(F.struct("element", "list")).alias("held")).select("key", F.col("held.element").alias("elements"), F.col("held.list").alias("lists"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["list", "bi", "bj"], 20_000):
            table = table.combine_chunks()
            starts = np.append(group_starts(table, ["list", "bi", "bj"]), table.num_rows).tolist()
            sizes, side, crossed = table["n"].to_numpy(), table["side"].to_numpy(), table["bi"].to_numpy() != table["bj"].to_numpy()
            odd = np.frombuffer(b"".join(table["odd"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
            names, counts, own_marks = table["list"].to_numpy(), pc.list_value_length(table["lists"]).to_numpy(), _matrix(table["sketch"].combine_chunks())
            marks, there = np.zeros((table.num_rows, FURTHER), np.int64), np.zeros((table.num_rows, FURTHER), bool)
            cells = np.repeat(np.arange(table.num_rows), counts), pc.list_flatten(table["elements"]).to_numpy()
            marks[cells], there[cells] = pc.list_flatten(table["lists"]).to_numpy(), True
            left, right = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                own = sizes[lo:hi]
                fits = np.minimum.outer(own, own) >= similar * np.maximum.outer(own, own)
                if crossed[lo]:
                    fits &= side[lo:hi, None] != side[None, lo:hi]
                i, j = np.nonzero(np.triu(fits, 1))
                for at in range(0, len(i), 50_000):
                    x, y = lo + i[at : at + 50_000], lo + j[at : at + 50_000]
                    differing = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64)
                    near = differing <= sizes[x] + sizes[y] - 2 * similar * np.maximum(sizes[x], sizes[y]) + 1e-6
                    x, y = x[near], y[near]
                    shared_at = ((marks[x] == marks[y]) & there[x] & there[y]).argmax(1)
                    here = (marks[x, shared_at] == names[lo]) & ((own_marks[x] == own_marks[y]).sum(1) < AGREE)
                    left.append(x[here])
                    right.append(y[here])
            if left:
                yield from _tiles(table, starts[:-1], np.concatenate(left), np.concatenate(right))

    dealt = split_groups(one.select("list", "key"), "list", "key", BLOCK).select("list", "bi", "bj", "side", "key").join(classes.select("key", "n", "sketch", "odd").join(held, "key"), "key")
    dealt = dealt.repartition("list", "bi", "bj").sortWithinPartitions("list", "bi", "bj", "key").select("list", "bi", "bj", "side", "key", "n", "sketch", "odd", "elements", "lists")
    return dealt.mapInArrow(choose, TILE_SCHEMA)


def _aligned_tiles(tiles: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(key, root, links): for each text of a tile that has similar ones there, how many, and the first text that these join it with.

    Every pair of a tile is aligned where both texts are; pairs are never rows.
    """
    place = ["kind", "list", "bi", "bj", "ti", "tj"]
    held = tiles.join(texts.select("key", "z"), "key").repartition(*place).sortWithinPartitions(*place, "nth").select(*place, "nth", "key", "z", "partners")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for table in sorted_groups(batches, place, 2 * TILE):
            starts = np.append(group_starts(table, place), table.num_rows).tolist()
            keys, zs, nths, partners = (table[c].to_pylist() for c in ("key", "z", "nth", "partners"))
            rows: list[tuple] = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                words = [text_words(expand.decompress(z)) for z in zs[lo:hi]]
                known: dict[int, list[int]] = {}
                held_words = 0
                at, root, links = {n: i for i, n in enumerate(nths[lo:hi])}, list(range(hi - lo)), [0] * (hi - lo)

                def top(i: int) -> int:
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                def listed(i: int) -> list[int]:
                    nonlocal held_words
                    if i not in known:
                        if held_words > 300_000:
                            known.clear()
                            held_words = 0
                        known[i] = words[i].tolist()
                        held_words += len(known[i])
                    return known[i]

                for i in range(hi - lo):
                    for j in map(at.__getitem__, partners[lo + i]):
                        if similarity(listed(i), listed(j), similar) >= similar:
                            links[i] += 1
                            links[j] += 1
                            u, v = sorted((top(i), top(j)))
                            root[v] = u
                rows += [(keys[lo + i], keys[lo + top(i)], n) for i, n in enumerate(links) if n]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))], ["key", "root", "links"])

    return held.mapInArrow(align, "key binary, root binary, links long")


def _aligned(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs with whether their edit similarity is at least ``similar``."""
    first = pairs.join(texts.select(F.col("key").alias("a"), F.col("z").alias("za")), "a")
    both = first.join(texts.select(F.col("key").alias("b"), F.col("z").alias("zb")), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        known: dict[bytes, list[int]] = {}
        held = 0

        def words(key: bytes, z: bytes) -> list[int]:
            nonlocal held
            if key not in known:
                if held > 300_000:
                    known.clear()
                    held = 0
                known[key] = text_words(expand.decompress(z)).tolist()
                held += len(known[key])
            return known[key]

        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            good = [similarity(words(x, zx), words(y, zy), similar) >= similar for x, y, zx, zy in zip(a, b, batch["za"].to_pylist(), batch["zb"].to_pylist())]
            yield pa.record_batch([batch["a"], batch["b"], pa.array(good, pa.bool_())], ["a", "b", "similar"])

    return both.mapInArrow(align, "a binary, b binary, similar boolean")
