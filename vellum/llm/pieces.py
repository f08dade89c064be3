"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed by hand; its normaliser, metaspace marker, scores (unigram) or merges (byte-pair models) and byte fallback are
rebuilt as a tokenizers pipeline. Texts are encoded in batches, the library's threads being used (THREADS a worker).
Where a byte-pair model has no piece with the marker after another character, texts may be cut before each run of markers without changing the result, so
a text's words are looked up and only new ones are encoded. (Unigram scores are summed over a text, and how near ties fall depends on the sums.) A text that holds the marker's own character is not cut, as a blank after it is no boundary.
A worker process builds a model's codec once and keeps it, and the chunks that it knows, for all tasks that it runs.

The ids are those of the tokenizers library, and so is what they decode to. Parity is a check on them: each distinct chunk is encoded by the
sentencepiece library too when it is first met, and a text's parity is false if a chunk of it differs. A text's ids are its chunks' ids joined. Texts that
are not cut are encoded by both libraries as a whole. Decoding is checked likewise: each chunk is decoded when it is first met.

Defined results: a null or empty text has no ids; a text of any length is encoded whole; repeated rows get equal results; an empty table gives an
empty table; other columns pass through.
"""

import gc
import hashlib
import os
import struct
import sys
import types
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.arrow import batched, only

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Chunks of each of two generations that a worker keeps the ids of, texts that it works on at once, and chunks that it encodes and decodes at once.
CACHE, TEXTS, CHUNKS, JOINED = 300_000, 256, 4096, 64
#: Threads of the library in each worker: as many as a task may use, not as many as the machine has.
THREADS = 2
FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, floats' four bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            n = varint() if wire == 2 else 4 if wire == 5 else 8
            yield number, data[at : at + n]
            at += n


class Parsed:
    """What of a model encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                self.pieces.append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.unigram = trainer.get(3, 1) == 1
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def merges(vocab: dict[str, int], pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best merged piece first."""
    out = []
    for piece, score, kind in pieces:
        if kind in (NORMAL, USER):
            for i in range(1, len(piece)):
                a, b = piece[:i], piece[i:]
                if a in vocab and b in vocab:
                    out.append((-score, vocab[piece], vocab[a], vocab[b], a, b))
    return [(x[4], x[5]) for x in sorted(out)]


def build(m: Parsed, bare: bool = False):
    """The tokenizers pipeline of a parsed model; bare: for texts whose marker is in place, without a normaliser."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {p[0]: i for i, p in enumerate(m.pieces)}
    if m.unigram:
        tok = Tokenizer(models.Unigram([(p[0], p[1]) for p in m.pieces], m.unknown, m.byte_fallback))
    else:
        plain = {p: i for p, i in vocab.items()}
        tok = Tokenizer(models.BPE(plain, merges(plain, m.pieces), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0 if bare else 10_000))
    steps: list = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if m.squeeze:
        # markers of the text's own go from its end too
        steps.append(normalizers.Replace(Regex(f"{MARK if m.escape else ' '}+\\z"), ""))
    if not bare:
        tok.normalizer = normalizers.Sequence(steps)
    tok.add_tokens([AddedToken(p[0], normalized=False, special=False) for p in m.pieces if p[2] == USER])
    tail: list = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] if m.byte_fallback else [decoders.Replace(MARK, " "), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*tail, *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return tok


def can_cut(m: Parsed) -> bool:
    """Whether no piece holds a marker after another character, and normalisation works on characters one by one: then texts without a marker
    of their own may be cut before blanks."""
    inner = any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))
    return not m.unigram and m.escape and m.dummy_prefix and any(p[0] == MARK for p in m.pieces) and not m.charsmap and not m.squeeze and not inner and not any(k == USER for _, _, k in m.pieces)


class Codec:
    """Encodes and decodes with one model; keeps the ids of chunks that it has met."""

    def __init__(self, data: bytes):
        import re

        import sentencepiece

        self.parsed = Parsed(data)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cut = re.compile(r" *[^ ]+| +$").findall if can_cut(self.parsed) else None
        self.bare = build(self.parsed, bare=True) if self.cut else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.lost: set[str] = set()
        self.mark = next((i for i, p in enumerate(self.parsed.pieces) if p[0] == MARK), -1)

    @cached_property
    def tok(self):
        """The pipeline with its normaliser, for texts that are not cut: most workers meet none."""
        return build(self.parsed)

    def raw(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """(ids, parity) of whole texts."""
        mine = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.sp.encode(texts, num_threads=1)
        return [(a, a == b) for a, b in zip(mine, theirs, strict=True)]

    def chunk(self, new: list[str]) -> None:
        """Takes up the ids of chunks: each starts with one blank at least, which is the marker that a text gets in front."""
        mine = [e.ids for e in self.bare.encode_batch_fast([c.replace(" ", MARK) for c in new], add_special_tokens=False)]
        theirs = self.sp.encode([c[1:] for c in new], num_threads=1)
        for i, c in enumerate(new):
            if c == " ":
                # a lone blank at the end of a text is the marker itself, which no text by itself gives
                mine[i] = theirs[i] = [self.mark]
        if mine != theirs:
            self.unlike.update(c for c, a, b in zip(new, mine, theirs, strict=True) if a != b)
        self.lost.update(self.not_said(new, mine))
        self.cache.update(zip(new, [array("i", ids).tobytes() for ids in mine], strict=True))

    def not_said(self, chunks: list[str], ids: list[list[int]]) -> Iterator[str]:
        """Those of chunks that their ids do not decode to. Decoding takes one blank from the front of a text; JOINED chunks are decoded as one text, as they
        stand in texts, and each by itself where that text is another."""
        for i in range(0, len(chunks), JOINED):
            if self.bare.decode(list(chain.from_iterable(ids[i : i + JOINED])), skip_special_tokens=False) != "".join(chunks[i : i + JOINED])[1:]:
                yield from (c for c, x in zip(chunks[i : i + JOINED], ids[i : i + JOINED], strict=True) if self.bare.decode(x, skip_special_tokens=False) != c[1:])

    def turn(self) -> None:
        """The older generation of chunks is forgotten, with what was known of them."""
        gone = self.old.keys() - self.cache.keys()
        self.unlike -= gone
        self.lost -= gone
        self.cache, self.old = {}, self.cache

    def uncut(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """What encode gives, for texts that are encoded and decoded whole."""
        coded = self.raw(texts)
        return [(np.array(ids, np.int32), ok, t == b) for t, (ids, ok), b in zip(texts, coded, self.decode([ids for ids, _ in coded]), strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """ids, parity and whether decoding gives the text back, of each text. Decoding goes chunk by chunk as encoding does: no piece and no
        run of byte pieces reaches across the blank that starts a chunk."""
        if self.cut is None:
            return self.uncut(texts)
        own = [i for i, t in enumerate(texts) if MARK in t]
        if own:
            out = self.encode(["" if MARK in t else t for t in texts])
            for i, coded in zip(own, self.uncut([texts[i] for i in own]), strict=True):
                out[i] = coded
            return out
        # the marker that starts a text stands for a blank before it
        chunks = [self.cut(" " + t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.turn()
        missing = set(chain.from_iterable(chunks)).difference(self.cache)
        known = missing.intersection(self.old)
        self.cache.update({c: self.old[c] for c in known})
        new = list(missing - known)
        for at in range(0, len(new), CHUNKS):
            self.chunk(new[at : at + CHUNKS])
        get = self.cache.__getitem__
        return [(np.frombuffer(b"".join(map(get, cs)), np.int32), not self.unlike or self.unlike.isdisjoint(cs), not self.lost or self.lost.isdisjoint(cs)) for cs in chunks]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return (self.bare or self.tok).decode_batch(ids, skip_special_tokens=False)


def codec_of(data: bytes) -> Codec:
    """The codec of a model, which the process keeps: what a task brings along is built anew for every task, a module is not."""
    kept = sys.modules.setdefault("vellum_llm_codecs", types.ModuleType("vellum_llm_codecs")).__dict__
    key = hashlib.sha256(data).hexdigest()
    if key not in kept:
        kept[key] = Codec(data)
        # the vocabulary stays, and a batch makes many short-lived lists: both cost much time in the garbage collector
        gc.freeze()
        gc.set_threshold(50_000, 20, 100)
    return kept[key]


def worker(model: str, digest: bool) -> Callable[[], Callable[[list], list[tuple]]]:
    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(model, "rb") as f:
            codec = codec_of(f.read())

        def run(texts: list) -> list[tuple]:
            # copies that a mix made lie next to each other
            once = list(dict.fromkeys(t or "" for t in texts))
            coded = dict(zip(once, codec.encode(once), strict=True))
            if digest:
                coded = {t: (len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), ok, back) for t, (ids, ok, back) in coded.items()}
            return [coded[t or ""] for t in texts]

        return run

    return make


def encoded(docs: DataFrame, model: str = MODEL, column: str = "text") -> DataFrame:
    """docs with ids, parity and round_trip (decoding gives the text back)."""
    return batched(docs, worker(model, False), column, FIELDS, TEXTS)


def decoded(docs: DataFrame, model: str = MODEL, column: str = "ids") -> DataFrame:
    """docs with decoded: the text that a column of ids stands for; null for null, and for ids that hold a null or that the model does not have."""

    def make():
        with open(model, "rb") as f:
            codec = codec_of(f.read())
        n = len(codec.parsed.pieces)

        def run(rows: list) -> list[tuple]:
            fine = [ids is not None and all(i is not None and 0 <= i < n for i in ids) for ids in rows]
            back = iter(codec.decode([ids for ids, ok in zip(rows, fine, strict=True) if ok]))
            return [(next(back) if ok else None,) for ok in fine]

        return run

    return batched(docs, make, column, T.StructType([T.StructField("decoded", T.StringType())]), TEXTS)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), parity, round_trip."""
    return batched(only(docs, "doc_id", "text"), worker(model, True), "text", DIGEST, TEXTS).drop("text")
