"""SentencePiece models run by the tokenizers library, checked against the sentencepiece library."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import passing, small_batches

#: The marker that stands for a space inside pieces (fixed by the model format).
MARK = "▁"
#: Kinds of pieces and models in the model file (fixed by its schema).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts on which every new backend is compared with the sentencepiece library.
PROBES = (
    "", " ", "  two  spaces ", "a", "Hello, world.", "line one\nline two\r\n\ttabbed", "Été naïve über straße ¿qué?",
    "漢字かな 한글", "\U0001f600\U0001f680 x", "<s> </s> <unk> <0x0A>", MARK + "mark" + MARK, "12345.678e-9", "á ë", "!!??%%$$", "\x00\x01 end", "under_score camelCase",
)


def read_model(content: bytes):
    """The parsed model message."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(content)
    return model


def merges_of(pieces) -> list[tuple[str, str]]:
    """BPE merges, best first: every split of a piece into two known pieces, in the order of the piece's score."""
    rank = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p in pieces:
        if p.type == NORMAL and len(p.piece) > 1:
            halves = [(p.piece[:i], p.piece[i:]) for i in range(1, len(p.piece))]
            found += [(-p.score, rank[a], rank[b], a, b) for a, b in halves if a in rank and b in rank]
    return [(a, b) for *_, a, b in sorted(found)]


def names_parted(pieces) -> list:
    """A splitter behind the first character of every name of a control, unknown or byte piece: such names in a text are text, which a unigram model would take for the pieces."""
    from tokenizers import Regex, pre_tokenizers

    names = [p.piece for p in pieces if p.type not in (NORMAL, USER_DEFINED) and len(p.piece) > 1]
    rests: dict[str, list[str]] = {}
    for name in names:
        rests.setdefault(name[0], []).append(re.escape(name[1:]))
    found = "|".join(f"{re.escape(first)}(?={'|'.join(rest)})" for first, rest in rests.items())
    return [pre_tokenizers.Split(Regex(found), "isolated")] if found else []


def build(content: bytes, verify: bool = True):
    """A tokenizers.Tokenizer that encodes and decodes as the model does.

    Rebuilds the normaliser (character map, extra white space, dummy prefix,
    marker), the unigram scores or BPE merges, byte fallback and the decoder.
    With ``verify`` it raises ValueError if any of PROBES is encoded otherwise
    than by the sentencepiece library.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = read_model(content)
    pieces, trainer, norm = list(proto.pieces), proto.trainer_spec, proto.normalizer_spec
    fallback = any(p.type == BYTE for p in pieces)
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in pieces], unknown, fallback)
    elif trainer.model_type == BPE:
        ids = {p.piece: i for i, p in enumerate(pieces)}
        model = models.BPE(ids, merges_of(pieces), unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"models of type {trainer.model_type} aren't handled")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if norm.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    parts = []
    # Where no piece has a marker after another character, no merge crosses the start of a marked word.
    if not any(MARK in p.piece.lstrip(MARK) for p in pieces if p.type == NORMAL):
        parts.append(pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated"))
    if trainer.model_type == UNIGRAM:
        parts += names_parted(pieces)
    if parts:
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(parts)
    own = [AddedToken(p.piece, normalized=False) for p in pieces if p.type == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if norm.add_dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    if verify:
        differing = unlike(tokenizer, reference(content), list(PROBES))
        if differing:
            raise ValueError(f"encoded otherwise than by sentencepiece: {differing[:3]!r}")
    return tokenizer


def reference(content: bytes):
    """The sentencepiece library's own processor."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def unlike(tokenizer, processor, texts: list[str]) -> list[str]:
    """The texts that the two encode differently."""
    ours = encode(tokenizer, texts)
    return [t for t, a, b in zip(texts, ours, processor.encode(texts, num_threads=1)) if a != b]


def encode(tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids of each text, by the library's threads; an empty text has none."""
    return [e.ids if t else [] for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False))]


class Codec:
    """Encodes and decodes texts of one model.

    Where the model's normaliser only marks spaces and no piece crosses a
    marked word's start, a text's ids are those of its words: each distinct word
    of a batch goes through the library's threaded batch encoder once, and a
    bounded memory keeps words' ids from batch to batch. Other models encode
    whole texts.
    """

    def __init__(self, content: bytes, verify: bool = False, most_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = build(content, verify)
        proto = read_model(content)
        norm = proto.normalizer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == NORMAL)
        self.by_word = bool(
            not crossing and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
            and norm.add_dummy_prefix and norm.escape_whitespaces and not any(p.type == USER_DEFINED for p in proto.pieces)
        )
        self.words = Tokenizer(self.tokenizer.model)
        if proto.trainer_spec.model_type == UNIGRAM and (parts := names_parted(proto.pieces)):
            self.words.pre_tokenizer = parts[0]
        self.most_words, self.known, self.unlike = most_words, {}, set()
        self.prefix = norm.add_dummy_prefix
        self.bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]

    def encode(self, texts: list[str], processor=None) -> list[np.ndarray] | tuple[list[np.ndarray], list[bool]]:
        """Ids of each text; with the library's processor, also whether it gives the same ids for the text (by_word: for each of its words)."""
        if not self.by_word:
            ids = [np.array(ids, np.int32) for ids in encode(self.tokenizer, texts)]
            return ids if processor is None else (ids, [own == i.tolist() for own, i in zip(processor.encode(texts, num_threads=1), ids)])
        split = [_marked_words(t) for t in texts]
        words = set().union(*split)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > self.most_words:
            self.known, self.unlike = {}, set()
            new = list(words)
        for lo in range(0, len(new), 5_000):
            some = new[lo : lo + 5_000]
            ids = [array("i", e.ids) for e in self.words.encode_batch_fast(some, add_special_tokens=False)]
            self.known.update(zip(some, (i.tobytes() for i in ids)))
            if processor is not None:
                self._compare(some, ids, processor)
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]
        return ids if processor is None else (ids, [not self.unlike or self.unlike.isdisjoint(words) for words in split])

    def forget(self) -> None:
        """Empties the memory of words: a worker that waits for other work holds none."""
        self.known, self.unlike = {}, set()

    def _compare(self, words: list[str], ids: list[array], processor) -> None:
        """Keeps the words that the library's processor encodes otherwise."""
        # The library sets the first marker itself, but not before an empty text: a lone marker follows a letter.
        before = processor.encode("x")
        own = processor.encode([("x" + w if w == MARK else w[1:]).replace(MARK, " ") for w in words], num_threads=1)
        self.unlike.update(w for w, i, o in zip(words, ids, own) if o != (before + i.tolist() if w == MARK else i.tolist()))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids: the pieces' bytes with spaces for markers, less the dummy prefix."""
        texts = [b"".join(map(self.bytes.__getitem__, some.tolist())).decode("utf-8", "replace") for some in ids]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def codec_of(content: bytes, threads: int = 2):
    """A Codec and the library's own processor, built once in a Python worker; the library's batches use ``threads`` threads."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return Codec(content), reference(content)


def _marked_words(text: str) -> list[str]:
    """A text's words, each with the markers before it."""
    if not text:
        return []
    if "  " not in text and MARK not in text and not text.startswith(" ") and not text.endswith(" "):
        return (MARK + text.replace(" ", f" {MARK}")).split(" ")
    return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows whose sizes come to about ``most``; a larger row stands with those before it."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


@passing("doc_id", "text")
def encoded(docs: DataFrame, content: bytes, text: str = "text", parity_every: int = 1, whole_every: int = 50) -> DataFrame:
    """docs with token_ids (array of int), decoded (text from those ids) and parity.

    parity is whether the sentencepiece library gives the same ids, for every
    text whose hash is divisible by ``parity_every`` (so for all of them) and
    null for the others. Where the ids of a text are those of its words, the
    library encodes each distinct word that a worker meets, and beside that the
    whole text where its hash is divisible by ``whole_every``, where the rebuilt
    decoder must also give what Codec.decode gives; with other models it encodes
    every text as a whole. One executor-side tokenizer per Python
    worker; batches go through the library's threads, about 200,000 characters
    at a time beside the longest text.

    Edge cases: a null text has null token_ids and decoded; an empty one has no
    ids and decodes to an empty text; characters unknown to the model become
    byte pieces, so decoding gives the text back; docs' other columns pass
    through, but the names added here are replaced; an empty table stays empty.
    """
    docs = docs.drop("token_ids", "decoded", "parity")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, processor = codec_of(shared.value)
        for batch in batches:
            sizes = pc.utf8_length(batch[text]).fill_null(0).to_numpy()
            for part in _slices(sizes, 200_000):
                some = batch.slice(part.start, part.stop - part.start)
                missing = some[text].is_null().to_numpy(zero_copy_only=False)
                look = some["_checked"].to_numpy(zero_copy_only=False)
                given = [t or "" for t in some[text].to_pylist()]
                ids, alike = codec.encode(given, processor)
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(np.concatenate(ids), pa.int32()))
                whole = some["_whole"].to_numpy(zero_copy_only=False) & look & codec.by_word
                texts = codec.decode(ids)
                decoded = pa.array([None if m else t for m, t in zip(missing, texts)], pa.string())
                own = iter(processor.encode([t for t, c in zip(given, whole) if c], num_threads=1)) if whole.any() else iter(())
                back = iter(codec.tokenizer.decode_batch([i.tolist() for i, c in zip(ids, whole) if c], skip_special_tokens=False)) if whole.any() else iter(())
                same = pa.array([(not w or (next(own) == i.tolist()) & (next(back) == t)) and a if c else None for i, t, c, a, w in zip(ids, texts, look, alike, whole)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(some[n] for n in names), lists, decoded, same], [*names, "token_ids", "decoded", "parity"])
        codec.forget()

    checked = F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(parity_every)) == 0)
    whole = F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(whole_every)) == 0)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("token_ids array<int>, decoded string, parity boolean").fields])
    return docs.withColumn("_checked", checked).withColumn("_whole", whole).mapInArrow(run, schema)


def round_trip(text: str = "text") -> Column:
    """Whether a row of encoded() decodes to its own text; null for a null text."""
    return F.col("decoded") == F.col(text)
