"""Fuzzy passage dedup: shared k-mer seeds, collinear chains through a Fenwick tree, aligned chains."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain as chain_of

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.anchors import anchors, gram_hashes
from lectern.llm.common import group_starts, passing, small_batches, sorted_groups, stored
from lectern.llm.exact_dedup import BITS, _bit, _in_set, _key_set
from lectern.llm.order_minhash import aligned_length
from lectern.llm.words import M1, mix, word_hashes, word_spans

#: Words of a seed (a power of two), and one in how many of a text's runs of SEED words is one. The choice is by the run alone, so an unchanged run is chosen in every text.
SEED, EACH = 4, 4
#: Words of a long seed (a power of two); every run of LONG + LONG_SPREAD - 1 words has one. Few places share a long seed, however frequent its lines are.
LONG, LONG_SPREAD = 32, 19
#: Places before it in the seed's list that a place is matched with at first besides the first one: of a seed, of a long seed. Places of longer lists that no passage covers then are compared with all others.
BEFORE, LONG_BEFORE = 1, 4
#: Words on each side of a place that are compared, and pairs of neighbouring words that two places of one passage of 50 words share there: 40 aligned words in 21 runs at most.
AROUND, SHARED = 50, 19
#: Places of one seed that are compared at once with as many others; places that a pair of words leads to one by one; classes that pairs of words of more places are counted in.
BLOCK, FEW, CLASSES = 16384, 64, 512
#: Pairs of places that are aligned at once.
ALIGNED = 8192
#: Places of one seed within a batch that are listed together; a seed with more is listed in pieces.
PIECE = 64
#: Matches that a chain has at least; a long seed counts as that many.
SUPPORT = 2
#: Of the matches on one diagonal one is chained in every so many words.
THIN = 10
#: Share of a chain's seeds (one in EACH words) that are matched where it is taken as a passage before it is aligned; long seeds that cover it do as well.
SURE = 0.5
#: A passage has at least this many words and this share of them aligned.
LEAST_WORDS, LIKE = 50, 0.8
#: Words between seeds over which a chain goes on, and its cost for each word of a gap.
MOST_GAP, GAP_COST = 60, 0.03
#: Slices of a text that are cut at once.
SLICES = 1000
#: Places by which aligned words of a gap may lie apart.
BAND = 30
#: Words that the alignment may go beyond a chain's ends.
BEYOND = 48
#: Groups of unlike texts that may share 60 bits of their md5.
MOST_CLASHES = 10_000


def words_of(data: bytes | memoryview) -> np.ndarray:
    """Hashes (32 bits, none of them 0) of a text's words."""
    array = np.frombuffer(data, np.uint8)
    return np.maximum(word_hashes(array, *word_spans(array)).astype(np.uint32), 1)


def _unpacked(packed: pa.BinaryArray) -> list[np.ndarray]:
    """Hashes of the words of several texts, as _hashed packs them."""
    expand = zstandard.ZstdDecompressor()
    return [np.frombuffer(expand.decompress(w.as_buffer()), np.uint32) for w in packed]


def chains(x: np.ndarray, y: np.ndarray, seed: int = SEED, most_gap: int = MOST_GAP, cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of matches (x, y), x strictly ascending: lists of match numbers, best chain first.

    A match goes on from the best earlier one of smaller y, less ``cost`` for
    each word of the gap on either side; a Fenwick tree over the ranks of y
    gives that best one, or, if that is too far off, a look at those near by. Chains end at gaps of more than ``most_gap`` words.
    """
    n = len(x)
    if n == 1:
        return [[0]]
    rank = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    size = max(rank) + 1
    best = [(-1e18, -1)] * (size + 1)
    xs, ys = x.tolist(), y.tolist()
    score, before = [0.0] * n, [-1] * n
    for i in range(n):
        top, r = (-1e18, -1), rank[i] - 1
        while r > 0:
            if best[r] > top:
                top = best[r]
            r &= r - 1
        own, place = float(seed), cost * (xs[i] + ys[i])
        j = top[1]
        if j >= 0 and (xs[i] - xs[j] > most_gap or ys[i] - ys[j] > most_gap):
            # The best one of smaller y is out of reach: the best within reach, among at most most_gap matches.
            top, j = (-1e18, -1), i - 1
            while j >= 0 and xs[i] - xs[j] <= most_gap:
                if 0 < ys[i] - ys[j] <= most_gap:
                    top = max(top, (score[j] + cost * (xs[j] + ys[j]), j))
                j -= 1
            j = top[1]
        if j >= 0 and xs[i] - xs[j] <= most_gap and ys[i] - ys[j] <= most_gap and top[0] - place > 0:
            # Overlapping seeds add only their new words.
            own = min(seed, xs[i] - xs[j], ys[i] - ys[j]) + top[0] - place
            before[i] = j
        score[i] = own
        entry, r = (own + place, i), rank[i]
        while r <= size:
            if entry > best[r]:
                best[r] = entry
            r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


#: Words that an extension may skip on one side, and words that must match behind them.
MOST_SKIP, LEAST_RUN = 3, 6


def _run(equal: np.ndarray, miss: int = -2) -> int:
    """Places of an ungapped extension with the best score (1 for a match, ``miss`` for another); the score may fall by 12."""
    if not len(equal):
        return 0
    score = np.cumsum(np.where(equal, 1, miss))
    peak = np.maximum.accumulate(np.maximum(score, 0))
    fallen = np.flatnonzero(peak - score > 12)
    if len(fallen):
        score = score[: fallen[0]]
    at = int(score.argmax()) if len(score) else 0
    return at + 1 if len(score) and score[at] > 0 else 0


def _level(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words at equal places of a gap's two sides, counted from its start or from its end."""
    n = min(len(a), len(b))
    return max(int((a[:n] == b[:n]).sum()), int((a[len(a) - n :] == b[len(b) - n :]).sum()))


def _extend(a: np.ndarray, b: np.ndarray, miss: int = -2, most_skip: int = MOST_SKIP) -> tuple[int, int, int]:
    """Words of a and of b that an extension from their starts covers, and how many of them match.

    Where the words stop matching, up to ``most_skip`` words of one side are skipped
    if a run of LEAST_RUN or more words follows.
    """
    i = j = same = 0
    while True:
        best = (0, 0, 0, 0)
        for skip in range(-most_skip, most_skip + 1) if i or j else (0,):
            x, y = a[i + max(0, skip) :], b[j + max(0, -skip) :]
            n = min(len(x), len(y))
            equal = x[:n] == y[:n]
            run = _run(equal, miss)
            hits = int(equal[:run].sum())
            if hits > best[0] and (hits >= LEAST_RUN or not (i or j)):
                best = (hits, run, i + max(0, skip), j + max(0, -skip))
        if not best[0]:
            return i, j, same
        same += best[0]
        i, j = best[2] + best[1], best[3] + best[1]


def align(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]], seed: int = SEED, miss: int = -2, straight: bool = False) -> tuple[int, int, int, int, int]:
    """(start, end) in a, (start, end) in b, and aligned words, of a chain of seeds at (i, j).

    Gaps between seeds are aligned by their longest common subsequence; both
    ends are extended (see _extend). With ``straight`` words are only compared
    at the seeds' own distance: places of one text that lie near each other
    would else be aligned with themselves.
    """
    i0, j0 = matches[0]
    same = 0
    end_i, end_j = i0, j0
    for i, j in matches:
        if i < end_i or j < end_j:  # overlaps the seed before: only what is new
            skip = max(end_i - i, end_j - j)
            if skip >= seed:
                continue
            i, j, length = i + skip, j + skip, seed - skip
        else:
            length = seed
        if i > end_i or j > end_j:
            same += _level(a[end_i:i], b[end_j:j]) if straight else aligned_length(a[end_i:i].tolist(), b[end_j:j].tolist(), BAND)
        same += length
        end_i, end_j = i + length, j + length
    skip = 0 if straight else MOST_SKIP
    more_i, more_j, hits = _extend(a[end_i:], b[end_j:], miss, skip)
    less_i, less_j, hits_before = _extend(a[:i0][::-1], b[:j0][::-1], miss, skip)
    return i0 - less_i, end_i + more_i, j0 - less_j, end_j + more_j, same + hits + hits_before


def _spaced(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places at, but of neighbours with one hash (a word said over and over) only two of every LONG_SPREAD, side by side."""
    if not len(at):
        return at
    new = np.concatenate(([True], (h[at[1:]] != h[at[:-1]]) | (np.diff(at) > 1)))
    begins = np.maximum.accumulate(np.where(new, at, 0))
    return at[(at - begins) % LONG_SPREAD < 2]


def _sown(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of several texts: hashes, numbers of their texts, and places. The two low bits of a hash are 0, those of a long seed 1."""
    hashes, texts, places = [], [], []
    for t, own in enumerate(words):
        short = gram_hashes(own, SEED)
        at = _spaced(short, np.flatnonzero(short % np.uint64(EACH) == 0))
        long = gram_hashes(own, LONG)
        far = _spaced(long, anchors(long, LONG_SPREAD))
        hashes += [short[at] & ~np.uint64(3), long[far] & ~np.uint64(3) | np.uint64(1)]
        places += [at, far]
        texts.append(np.full(len(at) + len(far), t))
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(places)


def _in_pieces(h: np.ndarray, rank: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row numbers, seeds): rows of seeds, where a seed with more than PIECE places is dealt into pieces of so many.

    A piece has a hash of its own. Its first place, the one of least rank, is
    also listed under the seed itself, so the seed's list ties the pieces together; there bit 1 of the seed tells that it has pieces.
    """
    order = np.lexsort((rank, h))
    same = h[order]
    starts = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    counts = np.diff(np.append(starts, len(same)))
    nth = np.arange(len(same)) - np.repeat(starts, counts)
    many = np.repeat(counts > PIECE, counts)
    piece = (nth // PIECE).astype(np.uint64)
    own = mix(same ^ mix(piece + np.array([salt], np.uint64) * M1)) & ~np.uint64(3) | same & np.uint64(3)
    again = many & (nth % PIECE == 0)
    return np.concatenate((np.where(many, own, same), same[again])), np.concatenate((order, order[again])), np.concatenate((same, same[again] | np.uint64(2)))


def _windows(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words around places and of their seeds, one row for each place; 0 beyond the text's ends."""
    at = places[:, None] + np.arange(-AROUND, SEED + AROUND)
    inside = (at >= 0) & (at < len(words))
    return np.where(inside, words[np.where(inside, at, 0)], np.uint32(0))


def _narrow(words: np.ndarray) -> np.ndarray:
    """Words by 16 bits, none of them 0: equal words stay equal, so a bound on what two windows share holds for these as well."""
    return np.where(words > 0, np.maximum(words >> np.uint32(16), 1), 0).astype(np.uint16)


def _pairs_of_words(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of the pairs of neighbouring words of windows, and how many each window has."""
    w = windows.astype(np.uint64)
    there = (windows[:, :-1] > 0) & (windows[:, 1:] > 0)
    return (((w[:, :-1] * M1 ^ w[:, 1:]) * M1 >> np.uint64(32)).astype(np.uint32))[there], there.sum(1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of words a and b (64 at most) the longest common subsequence of b's row and the first k words of a's, k from 0; 0 matches nothing."""
    rows, n = a.shape
    out = np.zeros((rows, n + 1), np.int64)
    equal = np.zeros((rows, 64), bool)
    present = b > 0
    left = np.full(rows, np.iinfo(np.uint64).max, np.uint64)  # a 0 for each word of b that ends a longer subsequence
    for k in range(n):
        equal[:, : b.shape[1]] = (b == a[:, k : k + 1]) & present
        same = left & np.packbits(equal, axis=1, bitorder="little").view(np.uint64)[:, 0]
        left = (left + same) | (left - same)
        out[:, k + 1] = np.bitwise_count(~left)
    return out


def _may_hold(a: np.ndarray, b: np.ndarray, least_words: int, aligned: int) -> np.ndarray:
    """Whether ``least_words`` words of window a around its seed, or all that there are, may have ``aligned`` ones that stand in the same order in window b."""
    most = max(0, min(least_words - SEED, AROUND))
    before = _in_order(a[:, :AROUND][:, ::-1][:, :most], b[:, :AROUND][:, ::-1])
    behind = _in_order(a[:, AROUND + SEED :][:, :most], b[:, AROUND + SEED :])
    return (before + behind[:, ::-1]).max(1) + SEED >= aligned


def _since(words: np.ndarray, places: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """For each of ascending places a hash of the words from the usable place before it up to it, 0 where that is more than AROUND words off."""
    out = np.zeros(len(places), np.uint64)
    last = np.maximum.accumulate(np.where(usable, places, -1))
    # Of several rows of one place none is before another.
    first = np.searchsorted(places, places)
    before = np.where(first > 0, last[first - 1], -1)
    near = np.flatnonzero((before >= 0) & (places - before <= AROUND))
    if len(near):
        lengths = places[near] - before[near]
        starts = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        values = mix(words[np.repeat(before[near], lengths) + within].astype(np.uint64) + (within.astype(np.uint64) + np.uint64(1)) * M1)
        out[near] = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _alike(values: np.ndarray, counts: np.ndarray, least: int = SHARED, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j: all pairs of bags that share ``least`` values or more, and some that share fewer; a bag has ``counts`` of the values (32 bits). With ``first`` only pairs whose i is below it.

    A value that few bags hold is counted pair by pair. Of the others a pair
    shares no more than either bag holds, nor more than their counts by class allow, so no pair is missed.
    """
    n = len(counts)
    first = n if first is None else first
    key = np.sort(values.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(n, dtype=np.uint64), counts))
    place = np.arange(len(key))
    nth = place - np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
    if nth.any():  # the second of equal values in a bag is another value
        other = mix((key >> np.uint64(32)) + nth.astype(np.uint64) * M1) >> np.uint64(32)
        key = np.sort(np.where(nth > 0, other << np.uint64(32) | key & np.uint64(0xFFFFFFFF), key))
    value, bag = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    held = np.diff(np.append(starts, len(value)))
    of_many = np.repeat(held > FEW, held)
    many = np.bincount(bag[of_many], minlength=n)
    single = np.repeat((held > 1) & (held <= FEW), held)
    v, b = value[single], bag[single]
    i, pairs = np.arange(len(v)), []
    for step in range(1, FEW):
        i = i[i + step < len(v)]
        i = i[v[i] == v[i + step]]
        if not len(i):
            break
        pairs.append(np.minimum(b[i], b[i + step]) * n + np.maximum(b[i], b[i + step]))
    found, shared = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
    one, two = found // n, found % n
    enough = (one != two) & (one < first) & (shared + np.minimum(many[one], many[two]) >= least)
    # Where both bags hold enough of the values of many, all pairs are counted by class below.
    full = many >= least
    sparse = enough & ~(full[one] & full[two])
    yield one[sparse], two[sparse]
    rows = np.flatnonzero(full)
    if len(rows) < 2:
        return
    slot = np.cumsum(full) - 1
    of_many &= full[bag]
    classes = (mix(value[of_many]) % np.uint64(CLASSES)).astype(np.int64)
    grid = np.bincount(slot[bag[of_many]] * CLASSES + classes, minlength=len(rows) * CLASSES).astype(np.float32).reshape(len(rows), CLASSES)
    dense = (one != two) & (one < first) & full[one] & full[two]
    one, two, shared = slot[one[dense]], slot[two[dense]], shared[dense]
    asked = int(np.searchsorted(rows, first))
    for lo in range(0, asked, 256):
        hi = min(lo + 256, asked)
        most = grid[lo:hi] @ grid[lo:].T
        own = slice(*np.searchsorted(one, (lo, hi)))
        most[one[own] - lo, two[own] - lo] += shared[own]
        i, j = np.nonzero(most > least - 0.5)
        later = j > i
        yield rows[i[later] + lo], rows[j[later] + lo]


def find_passages(docs: DataFrame, least_words: int = LEAST_WORDS, like: float = LIKE) -> DataFrame:
    """(id, start, end, of, of_start, of_end, words): word spans of distinct texts that an earlier text holds too, or an earlier place.

    docs: id (long, one for each distinct text), text. Seeds are runs of SEED
    words and of LONG words. Every place of a seed is matched with the seed's
    first place, the one of least (id, place), and with a few places before it
    in that order. A seed that is frequent in a batch of texts is listed in
    pieces, whose first places stand for them in the seed's own list, so no task gets all places of a hot seed.
    Where that isn't all pairs of a list, each place that no passage covers
    afterwards is compared with all earlier ones (see _compared), so none is left out.
    """
    small_batches(docs.sparkSession)
    return _found(stored(_hashed(docs.select("id", "text"), least_words)), least_words, like)


def _found(hashed: DataFrame, least_words: int = LEAST_WORDS, like: float = LIKE) -> DataFrame:
    """find_passages, of hashed words."""

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch["id"].to_numpy()
                h, number, places = _sown(_unpacked(batch["w"]))
                own_ids = ids[number]
                rank = np.lexsort((places, own_ids)).argsort()
                h, rows, seeds = _in_pieces(h, rank, int(ids[0]) & 0xFFFFFFFF)
                columns = (h.view(np.int64), own_ids[rows], places[rows].astype(np.int32), seeds.view(np.int64))
                yield from pa.table([pa.array(c) for c in columns], ["h", "id", "place", "seed"]).to_batches(100_000)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matches of each place of a seed's list (sorted by h, id, place) with the first place and with those just before it; a list need not be held at once.

        Places of lists that aren't matched in full this way are also given by themselves, with their seed; ``long`` is then 1 for those that may not have met all before them.
        """
        first = None  # (id, place) of the first place of the list that goes on
        kinds = [np.int64, np.int64, np.int32, np.int64]
        tail = [np.zeros(0, k) for k in kinds]  # last places of that list, which has more than are matched in full
        held = [np.zeros(0, k) for k in kinds]  # a short list that may go on
        for batch in chain_of(batches, (None,)):
            if batch is not None and not batch.num_rows:
                continue
            known = len(tail[0])
            new = [np.zeros(0, k) for k in kinds] if batch is None else [batch[c].to_numpy() for c in ("h", "id", "place", "seed")]
            h, ids, places, seeds = (np.concatenate(c) for c in zip(tail, held, new))
            if len(h) == known:
                continue
            # Copies in several tasks sow equal rows.
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])))
            h, ids, places, seeds = h[fresh], ids[fresh], places[fresh], seeds[fresh]
            held = [c[len(h) :] for c in (h, ids, places, seeds)]
            goes_on = known > 0 and h[-1] == tail[0][0]
            if batch is not None and not goes_on and (short := int((h == h[-1]).sum())) <= LONG_BEFORE + 2:
                held = [c[len(h) - short :] for c in (h, ids, places, seeds)]
                h, ids, places, seeds = (c[: len(h) - short] for c in (h, ids, places, seeds))
            if len(h) <= known:
                if len(h) and len(held[0]):
                    tail = [c[:0] for c in tail]
                continue
            new = np.concatenate(([True], h[1:] != h[:-1]))
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            of, of_place = ids[starts], places[starts]
            if known and h[0] == tail[0][0]:
                of[0], of_place[0] = first
            of, of_place = of[group], of_place[group]
            own = np.arange(len(h)) >= known
            long = (h & 3) == 1
            i = np.flatnonzero(own & ((ids != of) | (places != of_place)))
            out = [(ids[i], of[i], places[i], of_place[i], long[i])]
            for step in range(1, LONG_BEFORE + 1):
                i = np.flatnonzero(own[step:] & (h[step:] == h[:-step]) & (long[step:] | (step <= BEFORE))) + step
                i = i[(ids[i - step] != of[i]) | (places[i - step] != of_place[i])]
                out.append((ids[i], ids[i - step], places[i], places[i - step], long[i]))
            matched = np.where(long[starts], LONG_BEFORE, BEFORE) + 2
            parted = np.bitwise_or.reduceat(seeds ^ h, starts) != 0  # a piece, or a seed with pieces
            parted[0] |= known > 0
            rest = np.flatnonzero(own & (parted | (np.bincount(group) > matched))[group])
            late = (parted[group] | (np.arange(len(h)) - starts[group] >= matched[group]))[rest].astype(np.int32)
            last = np.flatnonzero(h == h[-1])[-LONG_BEFORE:]
            if len(held[0]) or batch is None:
                last = last[:0]
            first, tail = (of[-1], of_place[-1]), [h[last], ids[last], places[last], seeds[last]]
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
            if len(columns[0]):
                yield from pa.table([*columns[:4], columns[4].cast(pa.int32()), pa.nulls(len(columns[0]), pa.int64())], names).to_batches(50_000)
            if len(rest):
                none = pa.nulls(len(rest), pa.int64())
                columns = [pa.array(ids[rest]), none, pa.array(places[rest]), none.cast(pa.int32()), pa.array(late), pa.array(seeds[rest] & ~2)]
                yield from pa.table(columns, names).to_batches(50_000)

    names = ["id", "of", "place", "of_place", "long", "seed"]
    sown = hashed.mapInArrow(sow, "h long, id long, place int, seed long").repartition("h").sortWithinPartitions("h", "id", "place", F.desc("seed"))
    matched = stored(sown.mapInArrow(match, "id long, of long, place int, of_place int, long int, seed long"))
    links = matched.where("seed IS NULL").drop("seed")
    spans = stored(_aligned(hashed, links, least_words, like))
    rest = stored(_compared(hashed, matched.where("seed IS NOT NULL").select("seed", "id", "place", (F.col("long") == 1).alias("late")), spans, least_words, like))
    # Whatever else the two texts share goes into the same chains.
    again = links.join(rest.select("id", "of").distinct(), ["id", "of"], "left_semi")
    spans = spans.union(_aligned(hashed, rest.union(again.select(rest.columns)), least_words, like))
    before = Window.partitionBy("id").orderBy("start", F.desc("end"), "of", "of_start").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(before)).where("_reach IS NULL OR end > _reach").drop("_reach")


def _hashed(texts: DataFrame, least_words: int) -> DataFrame:
    """(id, n, w): how many words each text of ``least_words`` words or more has, and their hashes (see words_of), compressed; each id once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, counts, words = [], [], []
            for t, text in zip(batch["id"].to_pylist(), batch["text"]):
                if t not in seen:
                    seen.add(t)
                    own = words_of(text.as_buffer())
                    if len(own) >= least_words:
                        ids.append(t)
                        counts.append(len(own))
                        words.append(squeeze.compress(own.tobytes()))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(words, pa.binary())], ["id", "n", "w"])

    long = texts.where(F.octet_length("text") >= 2 * least_words - 1)
    return long.mapInArrow(hashes, "id long, n int, w binary").groupBy("id").agg(F.first("n").alias("n"), F.first("w").alias("w"))


def _those(hashed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, w) of the texts of ids, and of some others: most of the others aren't shuffled. The set of ids that is broadcast has 2^BITS bits, whatever the table."""
    bits = _key_set(ids.select(_bit(F.col("id"), BITS).alias("bit")), BITS)
    return _in_set(hashed.select("id", "w"), _bit(F.col("id"), BITS), bits, "_asked").where("_asked").drop("_asked")


def _with_back(known: DataFrame) -> DataFrame:
    """Places known (seed, id, place, open) with ``back``: the seed that begins up to SEED words before a short seed, and how far, which settles the words between them; null without one.

    Of open places it is an open one. Two places that have it in common are compared there, if the later one is open.
    """
    short = F.col("seed").bitwiseAND(3) == 0
    near = Window.partitionBy("id").orderBy("place").rangeBetween(-SEED, -1)
    before = lambda some: F.max(F.when(some, F.struct("place", "seed"))).over(near)
    known = known.withColumn("_any", before(short)).withColumn("_open", before(short & F.col("open")))
    known = known.withColumn("_back", F.when(short, F.when(F.col("open"), F.col("_open")).otherwise(F.col("_any"))))
    return known.select("seed", "id", "place", "open", F.when(F.col("_back").isNotNull(), F.xxhash64("_back.seed", F.col("place") - F.col("_back.place"))).alias("back"))


def _in_blocks(known: DataFrame) -> DataFrame:
    """Places (seed, id, place, open) of seeds with an open place, dealt into pairs of blocks ``bi <= bj`` in which each open place meets all others of its seed once, but for those that are compared at a seed before (see _with_back).

    ``side`` tells of which of the two blocks a row is. All places of a seed with BLOCK of them at most are one block. Of others those that
    ask and the rest have blocks of their own, of about BLOCK places: one that asks is in as many pairs as its seed has blocks, another one in as many
    as its seed has blocks of those: once, where few ask. Open places ask; where most places of a seed have one ``back`` and fewer have another one or none, these do: seeds of one frequent line are compared in full at its first seed only.
    """
    columns = ["seed", "id", "place", "open", "asks", "bi", "bj", "side"]
    sizes = known.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("o")).where("o > 0 AND n > 1")
    sizes = stored(sizes)
    some = sizes.where(F.col("n") <= BLOCK).select("seed", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("id", "place"), F.lit(16)).cast("int"))
    small = salted.join(some, ["seed", "_salt"]).select("seed", "id", "place", "open", F.col("open").alias("asks"), *(F.lit(0).alias(c) for c in columns[5:]))
    # A seed of BLOCK // 2 places or more is one of few: one in BLOCK // 2 of all places, at most.
    many = _with_back(known.join(F.broadcast(sizes.where(F.col("n") > BLOCK // 2).select("seed")), "seed"))
    led = many.where("back IS NOT NULL").groupBy("seed", "back").agg(F.count(F.lit(1)).alias("led"))
    large = sizes.where(F.col("n") > BLOCK).join(led.groupBy("seed").agg(F.max(F.struct("led", "back")).alias("_most")), "seed", "left")
    fewer = F.coalesce((F.col("_most.led") > F.col("n") / 2) & (F.col("n") - F.col("_most.led") < F.col("o")), F.lit(False))
    large = large.select("seed", "n", F.when(fewer, F.col("n") - F.col("_most.led")).otherwise(F.col("o")).alias("_a"), F.when(fewer, F.col("_most.back")).alias("_lead"))
    large = large.select("seed", "_lead", F.greatest(F.lit(1), F.ceil(F.col("_a") / BLOCK)).cast("int").alias("_ab"), F.ceil((F.col("n") - F.col("_a")) / BLOCK).cast("int").alias("_cb"))
    dealt = many.join(F.broadcast(large), "seed").withColumn("asks", F.when(F.col("_lead").isNull(), F.col("open")).otherwise(~F.col("back").eqNullSafe(F.col("_lead"))))
    nth = F.xxhash64("place", "id")
    own = F.when(F.col("asks"), F.pmod(nth, F.col("_ab"))).otherwise(F.col("_ab") + F.pmod(nth, F.greatest(F.lit(1), F.col("_cb")))).cast("int")
    met = F.when(F.col("asks"), F.col("_ab") + F.col("_cb")).otherwise(F.col("_ab"))
    pairs = dealt.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), met - 1)))
    return small.union(pairs.select(*columns[:5], F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), (F.col("_b") > F.col("_o")).cast("int").alias("side")))


def _compared(hashed: DataFrame, places: DataFrame, spans: DataFrame, least_words: int, like: float) -> DataFrame:
    """Matches (id, of, place, of_place, long) of late places (seed, id, place, late) that no passage covers with all earlier places of their seed that may be of one passage with them.

    Places are compared in pairs of blocks (see _in_blocks): by the pairs of
    words around them, then by the words that stand there in the same order.
    Where equal words lead up to both from an equal seed before them, the two are
    compared there. Of places of one text with equal surroundings the first stands for those that aren't late.
    """
    covered = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    inside = F.coalesce(F.exists("spans", lambda s: (s["start"] <= F.col("place")) & (F.col("place") + SEED <= s["end"])), F.lit(False))
    known = stored(places.join(covered, "id", "left").select("seed", "id", "place", (F.col("late") & ~inside).alias("open")))
    columns = ["place", "seed", "open", "asks", "bi", "bj", "side"]
    # Dealt into blocks before their surroundings are cut, which so are shuffled once.
    wanted = stored(_in_blocks(known).groupBy("id").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("at")))
    aligned = int(np.ceil(like * least_words))
    shared = max(1, aligned - 2 * (least_words - aligned) - 1)

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, pad = 2 * AROUND + SEED, np.zeros(AROUND + SEED, np.uint32)
        odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            # Texts one behind the other, with more than AROUND zeros between them.
            texts = _unpacked(batch["w"])
            words = np.concatenate([pad, *(p for t in texts for p in (t, pad))])
            begins = len(pad) + np.cumsum([0, *(len(t) + len(pad) for t in texts[:-1])])
            number = np.repeat(np.arange(len(texts)), np.diff(batch["at"].offsets.to_numpy()))
            given = batch["at"].flatten()
            place, seed, open_, asks, bi, bj, side = (given.field(c).to_numpy(zero_copy_only=False) for c in columns)
            ids, at = batch["id"].to_numpy()[number], begins[number] + place
            since = _since(words, at, (seed & 3 == 0) & open_)
            around, sent = (np.lib.stride_tricks.sliding_window_view(w, width) for w in (words, _narrow(words)))
            for lo in range(0, len(at), 8192):
                some = np.arange(lo, min(lo + 8192, len(at)))
                windows = around[at[some] - AROUND]
                same = mix(mix((windows * odd).sum(1, dtype=np.uint64) + seed[some].view(np.uint64)) + number[some].astype(np.uint64) * M1 + bi[some].astype(np.uint64))
                fresh = open_[some] | asks[some]
                rest = np.flatnonzero(~fresh)
                fresh[rest[np.unique(same[rest], return_index=True)[1]]] = True
                some = some[fresh]
                windows = np.ascontiguousarray(sent[at[some] - AROUND])
                cut = [pa.array(c[some]) for c in (seed, bi, bj, side, place, open_, asks, since, ids)]
                cut.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(some), [None, pa.py_buffer(windows)]).cast(pa.binary()))
                yield pa.record_batch(cut, ["seed", "bi", "bj", "side", "place", "open", "asks", "since", "id", "around"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["seed", "bi", "bj"], 20_000):
            starts = np.append(group_starts(table, ["seed", "bi", "bj"]), table.num_rows)
            ids, places, since, bi, bj, side, open_, asks = (table[c].to_numpy() for c in ("id", "place", "since", "bi", "bj", "side", "open", "asks"))
            windows = np.frombuffer(b"".join(table["around"].to_pylist()), np.uint16).reshape(-1, 2 * AROUND + SEED)
            values, counts = _pairs_of_words(windows)
            edges = np.concatenate(([0], np.cumsum(counts)))
            asked: list[tuple[np.ndarray, np.ndarray]] = []

            def those_alike() -> Iterator[pa.RecordBatch]:
                i, j = (np.concatenate(c) for c in zip(*asked)) if asked else (np.zeros(0, np.int64),) * 2
                asked.clear()
                for at in range(0, len(i), ALIGNED):
                    x, y = i[at : at + ALIGNED], j[at : at + ALIGNED]
                    alike = _may_hold(windows[x], windows[y], least_words, aligned)
                    x, y = x[alike], y[alike]
                    yield pa.record_batch([pa.array(c) for c in (ids[x], ids[y], places[x], places[y], np.full(len(x), 2, np.int32))], ["id", "of", "place", "of_place", "long"])

            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                first = int(asks[lo:hi].sum())  # those that ask are sorted before others
                if hi - lo < 2 or not first or (since[lo] and (since[lo:hi] == since[lo]).all()):
                    continue
                some = np.arange(hi - lo)
                # Of a few places all pairs are aligned straight away.
                few = (hi - lo) * first <= 4 * (hi - lo + 12)
                for i, j in [np.nonzero((some[:first, None] < some))] if few else _alike(values[edges[lo] : edges[hi]], counts[lo:hi], shared, first):
                    i, j = i + lo, j + lo
                    swap = (ids[i] < ids[j]) | (ids[i] == ids[j]) & (places[i] < places[j])
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    kept = open_[i] & ((since[i] == 0) | (since[i] != since[j])) & ((bi[i] == bj[i]) | (side[i] != side[j]))
                    asked.append((i[kept], j[kept]))
                    if sum(len(i) for i, _ in asked) >= ALIGNED:
                        yield from those_alike()
            yield from those_alike()

    rows = wanted.join(_those(hashed, wanted), "id").select("id", "w", "at").mapInArrow(surround, "seed long, bi int, bj int, side int, place int, open boolean, asks boolean, since long, id long, around binary")
    rows = rows.repartition("seed", "bi", "bj").sortWithinPartitions("seed", "bi", "bj", F.desc("asks"))
    return rows.mapInArrow(compare, "id long, of long, place int, of_place int, long int")


def _aligned(hashed: DataFrame, links: DataFrame, least_words: int, like: float) -> DataFrame:
    """Passages, as find_passages returns them, of matches (id, of, place, of_place, long: 1 for long seeds, 2 for places that were compared); some lie within others."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["id", "of"], 20_000):
            starts = np.append(group_starts(table, ["id", "of"]), table.num_rows)
            ids, ofs, xs, ys, long = (table[c].to_numpy() for c in ("id", "of", "place", "of_place", "long"))
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            counted = np.where(long > 0, SUPPORT, 1)
            enough = (np.bincount(group, counted) >= SUPPORT)[group]
            ids, ofs, xs, ys, group, counted, long = (c[enough] for c in (ids, ofs, xs, ys, group, counted, (long == 1).astype(np.int64)))
            if not len(ids):
                continue
            apart = xs.astype(np.int64) - ys
            order = np.lexsort((xs, apart, group))
            key = np.stack((group[order], apart[order], xs[order] // THIN))
            firsts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
            support, longs = (np.add.reduceat(c[order], firsts) for c in (counted, long))
            by_place = np.argsort(order[firsts], kind="stable")
            kept, support, longs = order[firsts][by_place], support[by_place], longs[by_place]
            ids, ofs, xs, ys, group = ids[kept], ofs[kept], xs[kept], ys[kept], group[kept]
            starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            rows: list[tuple] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                x, y, n, m = xs[lo:hi], ys[lo:hi], support[lo:hi], longs[lo:hi]
                for found in chains(x, y):
                    if (all_ := int(n[found].sum())) >= SUPPORT:
                        rows.append((int(ids[lo]), int(ofs[lo]), all_, int(m[found].sum()), x[found].tolist(), y[found].tolist()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield from pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "of", "support", "longs", "xs", "ys"]).to_batches(20_000)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of a text but those that lie within a better one that is a passage nearly for sure: most of its seeds are matched, and it is long enough."""
        for table in sorted_groups(batches, ["id"], 20_000):
            starts = np.append(group_starts(table, ["id"]), table.num_rows)
            support, longs, begins, ends = (table[c].to_numpy() for c in ("support", "longs", "begin", "end"))
            length = ends - begins
            sure = (length >= least_words) & ((support >= SURE * length / EACH) | (longs * LONG_SPREAD >= like * length))
            kept = np.ones(table.num_rows, bool)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if hi - lo < 2:
                    continue
                spans: list[tuple[int, int]] = []
                for i in (lo + np.lexsort((np.arange(hi - lo), -support[lo:hi], ~sure[lo:hi]))).tolist():
                    kept[i] = not any(a <= begins[i] and ends[i] <= b for a, b in spans)
                    if kept[i] and sure[i]:
                        spans.append((begins[i], ends[i]))
            yield from table.filter(pa.array(kept)).drop_columns(["begin", "end", "tie"]).to_batches(20_000)

    chained = links.repartition("id", "of").sortWithinPartitions("id", "of", "place", "of_place").mapInArrow(chain, "id long, of long, support int, longs int, xs array<int>, ys array<int>")
    chained = chained.withColumn("begin", F.element_at("xs", 1)).withColumn("end", F.element_at("xs", -1) + SEED)
    # Among equally good chains each text takes others, so that one text isn't asked for by all that resemble it.
    chained = chained.withColumn("tie", F.xxhash64("id", "of")).repartition("id").sortWithinPartitions("id", "tie")
    chained = chained.mapInArrow(choose, "id long, of long, support int, longs int, xs array<int>, ys array<int>").drop("support", "longs")
    chained = stored(chained.withColumn("chain", F.xxhash64("id", "of", F.element_at("xs", 1), F.element_at("ys", 1))))
    mine = chained.select("chain", F.lit(0).alias("side"), F.col("id").alias("text_id"), F.greatest(F.lit(0), F.element_at("xs", 1) - BEYOND).alias("lo"), (F.element_at("xs", -1) + SEED + BEYOND).alias("hi"))
    theirs = chained.select("chain", F.lit(1).alias("side"), F.col("of").alias("text_id"), F.greatest(F.lit(0), F.element_at("ys", 1) - BEYOND).alias("lo"), (F.element_at("ys", -1) + SEED + BEYOND).alias("hi"))
    asked = mine.union(theirs)
    # A text goes to its slices once for each SLICES of them, not once for each: a hot text's slices are dealt in blocks.
    blocks = asked.groupBy("text_id").agg(F.ceil(F.count(F.lit(1)) / SLICES).cast("int").alias("_blocks"))
    asked = asked.join(blocks, "text_id").groupBy("text_id", F.pmod(F.xxhash64("chain", "side"), F.col("_blocks")).alias("_block")).agg(F.collect_list(F.struct("chain", "side", "lo", "hi")).alias("slices"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch["slices"].flatten()
            edges = batch["slices"].offsets.to_numpy()
            edges = (edges - edges[0]).tolist()
            chain, side, lo, hi = (given.field(c).to_numpy() for c in ("chain", "side", "lo", "hi"))
            texts = _unpacked(batch["w"])
            number = np.repeat(np.arange(len(texts)), np.diff(edges)).tolist()
            for at in range(0, len(lo), 2000):
                out = [texts[t][a:b] for t, a, b in zip(number[at : at + 2000], lo[at : at + 2000].tolist(), hi[at : at + 2000].tolist())]
                offsets = np.concatenate(([0], np.cumsum([len(w) for w in out]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).view(np.int32)))
                yield pa.record_batch([pa.array(chain[at : at + 2000]), pa.array(side[at : at + 2000]), lists], ["chain", "side", "w"])

    ids = chained.select("id").union(chained.select("of"))
    wanted = asked.join(_those(hashed, ids).withColumnRenamed("id", "text_id"), "text_id").select("w", "slices")
    slices = wanted.mapInArrow(cut, "chain long, side int, w array<int>")
    both = slices.groupBy("chain").agg(F.max(F.when(F.col("side") == 0, F.col("w"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("w"))).alias("b"))
    ready = chained.join(both, "chain").select("id", "of", "xs", "ys", "a", "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "end", "of", "of_start", "of_end", "words"]
        for batch in batches:
            rows = []
            for t, of, xs, ys, wa, wb in zip(batch["id"].to_pylist(), batch["of"].to_pylist(), batch["xs"].to_pylist(), batch["ys"].to_pylist(), batch["a"], batch["b"]):
                # No more words can be aligned than the two have in common (in 2048 classes of words).
                if np.minimum(np.bincount(wa.values.to_numpy() & 2047, minlength=2048), np.bincount(wb.values.to_numpy() & 2047, minlength=2048)).sum() < like * least_words:
                    continue
                base, of_base = max(0, xs[0] - BEYOND), max(0, ys[0] - BEYOND)
                # A chain over two passages with unlike words between them fails as a whole: it is parted at its widest gap.
                todo = [[(x - base, y - of_base) for x, y in zip(xs, ys)]]
                while todo:
                    matches = todo.pop()
                    for miss in (-2, -1):
                        s, e, os_, oe, same = align(wa.values.to_numpy(), wb.values.to_numpy(), matches, miss=miss, straight=t == of)
                        if t == of:  # an earlier place of the same text: the passage starts behind that place's start
                            s = max(s, os_ + of_base - base + 1)
                        # Ends with many changed words are taken in only where the passage is too short without them.
                        if not least_words // 3 <= e - s < least_words:
                            break
                    if e - s >= least_words and same >= like * max(e - s, oe - os_):
                        rows.append((t, s + base, e + base, of, os_ + of_base, oe + of_base, same))
                    elif len(matches) > 1 and e - s >= least_words:
                        gaps = [max(b[0] - a[0], b[1] - a[1]) for a, b in zip(matches, matches[1:])]
                        at = gaps.index(max(gaps)) + 1
                        todo += [matches[:at], matches[at:]]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ready.mapInArrow(measure, "id long, start int, end int, of long, of_start int, of_end int, words int")


def with_text_ids(docs: DataFrame, name: str, digits: int = 15) -> DataFrame:
    """docs (text, more) with a long for each distinct text: 60 bits of its md5, or, where unlike texts share those, 60 others.

    Texts that share their first bits are counted over the whole table before
    (about n * n / 2**61 pairs among n texts: 43 among ten billion); only those
    bits come to the driver, MOST_CLASHES at most. So an id stands for 120 bits of
    a text. Null texts count as empty. ``digits`` is smaller in tests.
    """
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    one, two = (F.conv(F.substring(md5, at, n), 16, 10).cast("long") for at, n in ((2, digits), (17, 15)))
    shared = docs.select(one.alias("a"), two.alias("b")).groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y")
    clashes = [r["a"] for r in shared.select("a").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many texts share 60 bits of their md5")
    return docs.withColumn(name, F.when(one.isin(clashes), -1 - two).otherwise(one) if clashes else one)


def _repeats(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages of distinct texts (see find_passages), rows (id, doc_id, c) of equal text and doc_id, and the first one of each text.

    docs: id (with_text_ids), doc_id, text. A null doc_id is after all others. firsts:
    id, first_id, copies (all rows of the text), c (those with first_id), n (words; 0 of texts that are too short for a passage).
    """
    small_batches(docs.sparkSession)
    hashed = stored(_hashed(docs.select("id", "text"), options.get("least_words", LEAST_WORDS)))
    found = stored(_found(hashed, **options))
    rows = stored(docs.select("id", F.col("doc_id").cast("long").alias("doc_id")).groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c")).alias("f")
    firsts = rows.groupBy("id").agg(least, F.sum("c").alias("copies")).join(hashed.select("id", "n"), "id", "left")
    return found, rows, firsts.select("id", F.col("f.doc_id").alias("first_id"), "copies", F.col("f.c").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start_word, end_word, match_doc_id, match_start, match_end, aligned_words): one row per repeated passage.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A passage has ``least_words``
    words or more of which a share ``like`` is aligned in order with the place it
    repeats, in another document or earlier in its own. Of equal texts the one
    of least doc_id is first, and each other one repeats it as a whole.

    Edge cases: null, empty and short texts have no passage; a null doc_id is
    after all others; repeated rows repeat each other; other columns are left
    out; an empty table gives an empty result.
    """
    found, rows, firsts = _repeats(with_text_ids(docs.select("doc_id", "text"), "id"), **options)
    spans = found.join(firsts.select("id", F.col("first_id").alias("doc_id")), "id").join(firsts.select(F.col("id").alias("of"), F.col("first_id").alias("match_doc_id")), "of")
    passages = spans.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "match_doc_id", F.col("of_start").alias("match_start"), F.col("of_end").alias("match_end"), F.col("words").alias("aligned_words"))
    least = options.get("least_words", LEAST_WORDS)
    many = firsts.where((F.col("copies") > 1) & (F.col("n") >= least)).select("id", "first_id", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
    copies = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(many, ["id", "_s"])
    # All rows of a text but one repeat it.
    times = F.col("c") - F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.lit(1)).otherwise(F.lit(0))
    copies = copies.withColumn("_k", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return passages.union(copies.select("doc_id", F.lit(0), "n", "first_id", F.lit(0), "n", "n"))


@passing("doc_id", "text")
def without_passages(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated passages cut from their texts, with the white space behind each; a text that is one long repeat becomes empty.

    All rows of a text but one, of least doc_id, become empty too if they are
    long enough for a passage. Columns are those of docs; see repeated_passages.

    Edge cases: null, empty and short texts stay as they are; a null doc_id is
    after all others, and of several rows of equal text and doc_id any one stays;
    unlike texts of one doc_id keep what is their own; an empty table stays empty.
    """
    names = docs.columns
    docs = with_text_ids(docs, "_id")
    found, _, firsts = _repeats(docs.select(F.col("_id").alias("id"), "doc_id", "text"), **options)
    spans = found.groupBy("id").agg(F.collect_set(F.struct(F.col("start").alias("start_word"), F.col("end").alias("end_word"))).alias("_spans"))
    many = (F.col("copies") > 1) & (F.col("n") >= options.get("least_words", LEAST_WORDS))
    known = firsts.join(spans, "id", "left").where(F.col("_spans").isNotNull() | many)
    known = known.select(F.col("id").alias("_id"), "_spans", many.alias("_many"), F.col("first_id").alias("_first"), F.col("c").alias("_c"), F.col("n").alias("_words"))
    # Rows of one text are dealt to 16 tasks.
    dealt = docs.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    joined = dealt.join(known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["_id", "_s"], "left")
    first = F.col("doc_id").cast("long").eqNullSafe(F.col("_first"))
    # Several rows of the first doc_id: one of each partition, then one of those.
    several = F.coalesce(F.col("_many") & first & (F.col("_c") > 1), F.lit(False))
    own = Window.partitionBy("_id", "_p").orderBy("_id")
    one = Window.partitionBy("_id", F.when(F.col("_n") == 1, -1).otherwise(F.col("_p"))).orderBy("_id")
    equal = joined.where(several).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(own)).withColumn("_m", F.row_number().over(one))
    equal = equal.withColumn("_copy", (F.col("_n") > 1) | (F.col("_m") > 1)).drop("_p", "_n", "_m")
    joined = joined.where(~several).withColumn("_copy", F.coalesce(F.col("_many") & ~first, F.lit(False))).union(equal)
    whole = F.array(F.struct(F.lit(0).alias("start_word"), F.col("_words").alias("end_word")))
    gone = F.when(F.col("_copy"), whole).otherwise(F.col("_spans"))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, given in batches:
            yield pd.Series([t if t is None or s is None or not len(s) else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, given)], dtype=object)

    joined = joined.withColumn("_gone", gone)
    # Not pushed below the union, where each task would keep a worker for either side.
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut.asNondeterministic()("text", "_gone"))
    return joined.withColumn("text", text).select(*names)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of half-open spans of word numbers."""
    data = text.encode()
    starts, ends = word_spans(np.frombuffer(data, np.uint8))
    gone = np.zeros(len(starts) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    edges = np.append(starts, len(data))
    kept, last = [], 0
    runs = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(np.int8)))
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):
        kept.append(data[last : edges[a]])
        last = int(edges[b])
    kept.append(data[last:])
    return b"".join(kept).decode()
