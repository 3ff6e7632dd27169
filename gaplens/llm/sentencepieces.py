"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; from it the normaliser (character map, white
space rules), the meta space marker, the pieces with their scores, the merges or the
unigram lattice, and byte fallback are rebuilt. Batches of distinct words are encoded
by several threads and put together again. Parity and the way back are verified on
all words: each distinct one is encoded by the sentencepiece library as well, and
decoded. Of one text in ``WHOLE`` (by its checksum) the whole is encoded by that
library and decoded as well, so that putting together is verified too.

Words may be encoded apart because the vocabulary has no piece in which a marker
follows another character (checked when the model is read; a model with such pieces,
or with a normaliser that changes texts, is encoded and compared by whole texts).

Edge cases: a null text counts as empty and has no tokens; control strings inside a
text are plain text; a text that holds the marker itself (U+2581) comes back with
spaces there, so ``exact`` is false; repeated rows are encoded alike; ids may be null;
a very long text is one list of words and ids in one task, some tens of times its
size; other columns are carried along in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
MARK = "▁"
#: Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Megabytes of words remembered by a task, bytes that one takes besides its own and its tokens', and code points
#: over which a word is not remembered.
MEMO_MB, ENTRY, LONG_WORD = 128, 200, 64
#: One over the share of texts that are verified as a whole.
WHOLE = 64
#: Words encoded as one sequence.
GROUP = 64
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SPACED = re.compile(" +[^ ]*")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: lambda: 8, 5: lambda: 4, 2: number}[key & 7]()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marks: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                m.pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, b"\0" * 4), "<f4")[0]), p.get(3, NORMAL)))
            elif number == 2:
                p = dict(_fields(value))
                m.kind, m.byte_fallback, m.suffix_marks = p.get(3, UNIGRAM), bool(p.get(35, 0)), bool(p.get(24, 0))
            elif number == 3:
                p = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.strip_spaces = p.get(2, b""), bool(p.get(3, 1)), bool(p.get(4, 1))
        if m.kind not in (UNIGRAM, BPE) or m.suffix_marks:
            raise ValueError("only unigram and BPE models with prefix markers are supported")
        return m

    @property
    def by_word(self) -> bool:
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def backend(m: Model):
    """The tokenizer of the tokenizers library that the model describes."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p: (score, i) for i, (p, score, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
        merges = []
        for p, (score, i) in usable.items():
            for cut in range(1, len(p)):
                if p[:cut] in usable and p[cut:] in usable:
                    merges.append((-score, i, cut, (p[:cut], p[cut:])))
        merges.sort()
        core = models.BPE(vocab=vocab, merges=[x[-1] for x in merges], unk_token=m.pieces[unknown][0] if unknown is not None else None, byte_fallback=m.byte_fallback, fuse_unk=True)
    else:
        core = models.Unigram([(p, score) for p, score, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if m.by_word:
        made.pre_tokenizer = pre_tokenizers.Split(Regex(WORDS.pattern), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER]
    if own:
        made.add_tokens(own)
    made.encode_special_tokens = True
    return made


class Codec:
    """Encodes and decodes batches, and verifies parity."""

    def __init__(self, raw: bytes, threads: int = THREADS, memo_mb: int = MEMO_MB, whole: int = WHOLE):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.model = Model.parse(raw)
        self.backend = backend(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        # words can be taken out of a text only where the normaliser leaves text alone
        own = any(kind == USER for *_, kind in self.model.pieces)
        self.plain = self.model.by_word and self.model.dummy_prefix and not self.model.charsmap and not self.model.strip_spaces and not own
        if self.plain:  # takes words that hold their markers already
            self.words = backend(self.model)
            self.words.normalizer = None
            self.words.pre_tokenizer = None
        self.most, self.held, self.share = memo_mb << 20, 0, whole
        self.memo: dict[str, bytes] = {}
        self.bad: set[str] = set()
        self.lossy: set[str] = set()

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts."""
        return [x.ids if t else [] for t, x in zip(texts, self.backend.encode_batch_fast(texts, add_special_tokens=False))]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Token ids of each text, whether they decode to it, and whether both libraries agree on them.

        Each distinct word is encoded, decoded and compared once, in batches, and remembered for the next ones.
        """
        if not self.plain:
            ids = self.whole(texts)
            same = [self.other.encode(t, num_threads=1) == i if t else not i for t, i in zip(texts, ids)]
            ids = [np.array(i, np.int32) for i in ids]
            return ids, [a == b for a, b in zip(texts, self.decode(ids))], same
        if self.held > self.most:
            self.memo.clear()
            self.held = 0
        # a space stands for the marker here, as the normaliser has it: such words take less memory
        cut = [SPACED.findall((" " + t).replace(MARK, " ")) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(self.memo))
        raws, bare = self._encode_words([w.replace(" ", MARK) for w in fresh]), [w[1:] for w in fresh]
        self.memo.update(zip(fresh, raws))
        self.held += ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, raws))
        # the other library puts the first marker back itself; alone it can't be asked for
        told = self.other.encode(bare, num_threads=1)
        self.bad.update(w for w, a, b in zip(fresh, raws, told) if a != array("i", b).tobytes() and w != " ")
        self.lossy.update(self._lossy(fresh, raws))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in cut]
        for w in fresh:
            if len(w) > LONG_WORD:
                self.held -= ENTRY + len(w) + len(self.memo.pop(w))
        exact = [MARK not in t and (not self.lossy or self.lossy.isdisjoint(words)) for t, words in zip(texts, cut)]
        same = [not self.bad or self.bad.isdisjoint(words) for words in cut]
        for k, t in enumerate(texts):
            if t and zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.share == 0:
                same[k] = same[k] and array("i", self.other.encode(t, num_threads=1)).tobytes() == out[k].tobytes()
                exact[k] = exact[k] and self.decode([out[k]])[0] == t
        return out, exact, same

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, as bytes; words go to the library in groups."""
        groups = [words[at : at + GROUP] for at in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for group, x in zip(groups, self.words.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
            raw = array("i", x.ids).tobytes()
            ends = (4 * np.searchsorted(np.array(x.word_ids, np.int64), np.arange(len(group) + 1))).tolist()
            out += [raw[i:j] for i, j in zip(ends, ends[1:])]
        return out

    def _lossy(self, words: list[str], raws: list[bytes]) -> list[str]:
        """The words that do not decode to themselves; groups that do are done at once."""
        spans = [(at, at + GROUP) for at in range(0, len(words), GROUP)]
        whole = self.decode([np.frombuffer(b"".join(raws[a:b]), np.int32) for a, b in spans])
        again = [k for (a, b), text in zip(spans, whole) if text != "".join(words[a:b])[1:] for k in range(a, min(b, len(words)))]
        back = self.decode([np.frombuffer(raws[k], np.int32) for k in again]) if again else []
        return [words[k] for k, text in zip(again, back) if text != words[k][1:]]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.backend.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL, threads: int = THREADS, memo_mb: int = MEMO_MB, carry: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """(row, ids, n_tokens, ids_sha256, exact, parity): token ids of each text; whether they decode to it and both libraries agree.

    ``exact`` and ``parity`` are verified on the text's distinct words, and on the whole text for one in ``WHOLE``.
    ``row`` holds the columns ``carry`` (all, if not given). ``ids_sha256`` is of the ids as
    little-endian 32-bit numbers; ``with_ids`` false leaves the ids themselves away. A task
    remembers words up to ``memo_mb`` megabytes. The model file is read on the
    driver and travels with the tasks.
    """
    with open(model, "rb") as f:
        raw = f.read()
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids_type = pa.list_(pa.int32())
    names = ["row", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "exact", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(raw, threads, memo_mb)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                ids, exact, same = codec.encode(part.column(1).to_pylist())
                sizes = np.array([len(i) for i in ids], np.int64)
                arrays = [part.column(0)]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))).cast(ids_type))
                arrays += [pa.array(sizes), pa.array([ids_sha256(i) for i in ids]), pa.array(exact), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ddl = "ids array<int>, n_tokens long, ids_sha256 string, exact boolean, parity boolean"
    fields = [rows.schema["row"], *(f for f in T._parse_datatype_string(ddl).fields if f.name in names)]
    return rows.mapInArrow(run, T.StructType(fields))


def ids_sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: their number and digest, and both verifications."""
    out = encoded(table(spark, sf_dir, "documents"), carry=["doc_id"], with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "exact", "parity")
