"""Operators beside plain sets, tables and loops: fingerprints, languages, quality, unigram models, page verdicts, chains."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints, language_id, order_minhash, passages, quality_gam, sentencepiece_codec, url_filter
from lectern.llm.common import components, split_groups


# -- fingerprints ---------------------------------------------------------------------


def test_containment_and_distinct_shingles(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    whole = rng.choices(words, k=3000)
    pairs = [(whole, whole[:1000]), (whole[:50], whole), (whole, [f"x{i}" for i in range(900)]), ([], whole), (whole, [])]
    rows = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    made = rows.select("k", *(fingerprints.sketch(F.col(c)).alias(c) for c in "ab"))
    got = made.select("k", fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).orderBy("k").collect()
    runs = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for r, (a, b) in zip(got, pairs):
        want = len(runs(a) & runs(b)) / len(runs(a)) if a else 1.0
        assert r.c == pytest.approx(want, abs=0.15) and r.n == pytest.approx(len(runs(a)), rel=0.25)


# -- languages ---------------------------------------------------------------------------


def plain_grams(text):
    """N-grams inside words, the space beside a word being its first or last place."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in language_id.ORDERS:
            out += [padded[i : i + n] for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1] and padded[i : i + n].strip()]
    return out


def test_ngrams_are_those_of_plain_strings():
    for text in ("The cat, 2 dogs", "é", "", "straße über", "a bc def"):
        found, counts = language_id.grams([text])
        assert len(found) == counts[0] == len(plain_grams(text)) and len(set(found.tolist())) == len(set(plain_grams(text)))


def test_languages_equal_plain_sets():
    """The popcounts of the filters, corrected, rank languages as counts over plain sets of n-grams do."""
    rng = random.Random(5)
    letters = {"aa": "abcdefghij", "bb": "fghijklmno", "cc": "klmnopqrst"}
    word = lambda l: "".join(rng.choices(letters[l], k=rng.randint(2, 7)))
    corpus = {l: [" ".join(word(l) for _ in range(60)) for _ in range(30)] for l in letters}
    sets = {l: set().union(*map(plain_grams, t)) for l, t in corpus.items()}
    filters = language_id.Filters.of(list(letters), [np.unique(language_id.grams([" ".join(t)])[0]) for t in corpus.values()])
    texts = [" ".join(word(rng.choice(list(letters))) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    got, scores = filters.identify(texts)
    for text, lang, score in zip(texts, got, scores):
        counts = {l: sum(g in s for g in plain_grams(text)) for l, s in sets.items()}
        best = max(counts.values())
        assert counts[lang] >= best - 0.02 * len(plain_grams(text)) - 1
        if len(plain_grams(text)) > 40:
            assert score == pytest.approx(counts[lang] / sum(counts.values()), abs=0.06)


# -- quality --------------------------------------------------------------------------------


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(6)
    x = rng.random((400, 5))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=10, most_pairs=3)
    for row, score in zip(x, model.score(x)):
        bins = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[f], bins[g]] for (f, g), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_features_of_a_text():
    got = dict(zip(quality_gam.FEATURES, quality_gam.features("Ab ab 12!\nab ab\nab ab")))
    assert got["log_chars"] == pytest.approx(math.log1p(21)) and got["log_words"] == pytest.approx(math.log1p(7))
    assert got["distinct_words"] == pytest.approx(3 / 7) and got["repeated_word"] == pytest.approx(3 / 7) and got["top_word"] == pytest.approx(5 / 7)
    assert got["repeated_line"] == pytest.approx(1 / 3) and got["digit"] == pytest.approx(2 / 15) and got["loud_mark"] == pytest.approx(1 / 15)


# -- SentencePiece ---------------------------------------------------------------------------


def unigram_model():
    """A small unigram model message: bytes, letters and some words with scores of their own."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    add = lambda piece, score, kind=1: model.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0.0, 2), add("<s>", 0.0, 3), add("</s>", 0.0, 3)
    for i in range(256):
        add(f"<0x{i:02X}>", 0.0, 6)
    mark = sentencepiece_codec.MARK
    for k, piece in enumerate([mark, *"etaoinshrdlucmfwypvbgkqjxz.,é", "th", "he", "the", "in", "ing", "an", "and", mark + "t", mark + "the", mark + "and", "tion", "er", mark + "a", "ld", "wor", mark + "world"]):
        add(piece, -2.0 - 0.37 * k + (5.0 if len(piece) > 2 else 0.0))
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 1, 2, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", True, False, True
    return model.SerializeToString()


def test_unigram_models_have_parity(spark):
    content = unigram_model()
    processor = sentencepiece_codec.reference(content)
    rng = random.Random(3)
    texts = ["the world and the nation", "  two  spaces", "漢字 x", "", "ending "] + [" ".join("".join(rng.choices("etaoinshrdlé😀", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    assert not sentencepiece_codec.unlike(sentencepiece_codec.build(content), processor, texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id int, text string")
    rows = sentencepiece_codec.encoded(docs, content).collect()
    assert all(r.parity for r in rows if r.text is not None) and all(r.decoded == r.text for r in rows)


# -- pages ---------------------------------------------------------------------------------


def test_verdicts_equal_a_plain_walk_over_links(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.net" for i in range(30)] + ["good.org", "shop.com", "x.example.org"]
    pages = []
    for i in range(160):
        links = " ".join(f'<a href="http://{rng.choice(hosts)}/p{k}">x</a>' for k in range(rng.randint(0, 5)))
        pages.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'en'])}/{i}", links))
    pages += [(900, None, "<a href='http://good.org/'>"), (901, "no scheme", None)]

    def split(url):
        if not url or "://" not in url:
            return "", ""
        host, slash, path = url.partition("://")[2].partition("/")
        return host, slash + path

    def rule(host, path):
        fits = [r for r in url_filter.RULES if (host == (n := r[1].partition("/"))[0] or host.endswith("." + n[0])) and path.startswith("/" + n[2])]
        return max(fits, key=lambda r: len(r[1]), default=None)

    said = {i: rule(*split(u)) for i, u, _ in pages}
    edges, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for i, u, html in pages:
        host = split(u)[0]
        if said[i]:
            seeds[said[i][0]][host] += 1
        for to in re.findall(r"http://([^/]+)/", html or ""):
            if host and to != host:
                edges[host, to] += 1

    def walk(kind):
        ways, out = defaultdict(float), Counter()
        for (s, t), n in edges.items():
            ways[(s, t) if kind == "allow" else (t, s)] += n
        for (s, _), n in ways.items():
            out[s] += n
        start = {h: n / sum(seeds[kind].values()) for h, n in seeds[kind].items()}
        rank = dict(start)
        for _ in range(15):
            new = defaultdict(float, {h: 0.15 * w for h, w in start.items()})
            for (s, t), n in ways.items():
                new[t] += 0.85 * rank.get(s, 0) * n / out[s]
            rank = new
        return rank

    trust, distrust = walk("allow"), walk("block")
    rows = {r.page_id: r for r in url_filter.judge_pages(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert len(rows) == len(pages)
    for i, u, _ in pages:
        host = split(u)[0]
        bad = distrust.get(host, 0) > 0.5 * (trust.get(host, 0) + distrust.get(host, 0))
        assert rows[i].verdict == (said[i][0] if said[i] else "block" if bad and host else "allow"), (i, u)
        assert rows[i].rule == (said[i][1] if said[i] else None)
    assert {r.verdict for r in rows.values() if r.rule is None} == {"allow", "block"}


# -- chains, lists and components --------------------------------------------------------------


def test_scores_of_chains_equal_a_plain_search():
    """The best chain's own score against the best of all predecessors tried one by one."""
    rng = random.Random(4)
    for _ in range(200):
        x = np.array(sorted(rng.sample(range(200), rng.randint(1, 40))))
        y = np.array([rng.randrange(60) if rng.random() < 0.3 else v // 3 * 2 for v in x.tolist()])
        gain = lambda i, j: min(passages.SEED, x[i] - x[j], y[i] - y[j]) - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j])
        best = []
        for i in range(len(x)):
            own = [best[j] + gain(i, j) for j in range(i) if 0 < x[i] - x[j] <= passages.MOST_GAP and 0 < y[i] - y[j] <= passages.MOST_GAP]
            best.append(max([float(passages.SEED), *(o for o in own if o > 0 and o > passages.SEED)]))
        chain = passages.chains(x, y)[0]
        score = passages.SEED + sum(gain(b, a) for a, b in zip(chain, chain[1:]))
        assert score >= max(best) - passages.GAP_COST * passages.MOST_GAP * 2


def test_a_hot_list_is_dealt_in_blocks(spark):
    rows = spark.range(5_000).select(F.lit(7).cast("long").alias("list"), F.col("id").alias("key"))
    dealt = split_groups(rows, "list", "key", 1_000)
    sizes = [r["count"] for r in dealt.groupBy("list", "bi", "bj").count().collect()]
    assert max(sizes) <= 2_400 and sum(sizes) == 5_000 * 5
    assert split_groups(rows.withColumn("c", F.lit(1)), "list", "key", 1_000, "c").count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    path, star = [names[i] for i in range(61)], [names[i] for i in range(100, 160)]
    assert got == {i: min(path) for i in path} | {i: min(star) for i in star}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def test_edit_similarity():
    assert order_minhash.similarity([1, 2, 3, 4, 5], [1, 2, 9, 4, 5]) == pytest.approx(0.8)
    assert order_minhash.similarity([1] * 10, [1] * 7) == 0.0 and order_minhash.similarity([], []) == 1.0 and order_minhash.similarity([1], []) == 0.0
