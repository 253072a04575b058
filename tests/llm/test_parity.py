"""Parity with the sentencepiece library is said of every text."""

from lectern.llm import sentencepiece_codec as S
from lectern.llm.queries import model_bytes


def test_every_text_has_its_parity(spark):
    texts = [None, "", " ", "a  b ", "▁▁ x", *(f"some words no {i} 漢字 😀\n\tend" for i in range(120))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.parity for r in S.encoded(docs, model_bytes()).collect()}
    assert got == {i: None if t is None else True for i, t in enumerate(texts)}


def test_a_word_that_the_library_encodes_otherwise_is_seen():
    codec, processor = S.codec_of(model_bytes())
    texts = ["one two", "three two  ", "three", "", "four  "]
    assert codec.encode(texts, processor)[1] == [True] * 5

    class Other:
        def encode(self, given, **options):
            if isinstance(given, str):
                return processor.encode(given)
            return [i + [1] if "two" in t else i for t, i in zip(given, processor.encode(given))]

    assert S.Codec(model_bytes()).encode(texts, Other())[1] == [False, False, True, True, True]
