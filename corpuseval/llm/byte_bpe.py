"""Byte-level BPE encoding and decoding with a SentencePiece BPE model made from a rank vocabulary.

``model_from_ranks`` writes the model's protocol buffer directly: one piece per vocabulary entry, its bytes
mapped to one character each, the negative rank as score, identity normalisation.  SentencePiece then merges
the neighbours of best score first, which is the merge order of the ranks.  Texts are cut into pre-tokens by
the tokenizer's pattern; a pre-token that is itself an entry is that entry, all others go through the model.
Nothing is trained.

Null text counts as empty and gives no ids.  Texts are handled in runs of whole rows of about a megabyte, or one longer text: a run,
its units or a part of its pre-tokens, its ids and the caches are what is in memory.  Rows keep their order and number, repeated rows are encoded alike,
and only the two columns named are read, so further columns cannot clash.  Bytes that are no UTF-8 become U+FFFD first.
"""

from __future__ import annotations

import base64
import string
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import _text
from corpuseval.llm._session import read_texts, valid_text

#: Bytes are shown to SentencePiece as the characters from this code on.
_FIRST_CHARACTER = 0x100
_RUN = 100_000  # pre-tokens handled at once
_KEPT = 100_000  # pre-tokens, and twice as many units, whose ids a worker remembers before it starts anew
_LATIN_END = "\u0250"  # below, str.isalpha() is \p{L} in every version of Unicode
_SHIFT = {b: _FIRST_CHARACTER + b for b in range(256)}
_PAIRS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def read_ranks(content: bytes) -> list[bytes]:
    """Entries of a rank file (base64 token, rank) in rank order; ranks must be 0, 1, 2 ..."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines()) if token}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be gapless from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: varint for int, four bytes for float, length-delimited for bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _mapped(token: bytes) -> str:
    return "".join(chr(_FIRST_CHARACTER + b) for b in token)


def model_from_ranks(tokens: list[bytes]) -> bytes:
    """Serialised SentencePiece model; piece i + 1 is token i, piece 0 is the unknown piece."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("<unk>", 0, 2), *(piece(_mapped(t), -rank, 1) for rank, t in enumerate(tokens))]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)  # model type BPE, size, id of <unk>
    trainer += b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # no marks of begin, end or padding
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))  # no prefix, no trimming, no escapes
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens and of units (what stands between single spaces).

    ``split_at_spaces`` states that the pattern always starts a pre-token at a space that follows anything but
    white space, that a space and the letters
    after it are one pre-token, and that punctuation after those is another; ``encode`` tries that on probes and raises where it does not hold.  Texts where white space never precedes a space are then cut at spaces first, and the pattern
    runs once for each new unit and not for each word of the text.
    """

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str, split_at_spaces: bool):
        import regex
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._pattern = regex.compile(pattern)
        self._whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self._split = split_at_spaces
        self._words: dict[str, bytes] = {}
        self._units: dict[str, bytes] = {}

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        """Ids of pre-tokens by the vocabulary alone or the model's merges."""
        raw = [w.encode() for w in words]
        found = self._pieces.encode([r.decode("latin-1").translate(_SHIFT) for r in raw], num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), np.int64) - 1
        if len(flat) and flat.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        data, low = flat.astype("<u4").tobytes(), 0
        for token, pieces in zip(raw, found, strict=True):
            high = low + 4 * len(pieces)
            yield self._whole.get(token) or data[low:high]
            low = high

    def _learn_words(self, words: set[str]) -> None:
        if len(self._words) > _KEPT:
            self._words.clear()
        new = list(words.difference(self._words))
        self._words.update(zip(new, self._merged(new), strict=True))

    def _learn_units(self, units: set[str]) -> None:
        if len(self._units) > 2 * _KEPT:
            self._units.clear()
        new, stems = units.difference(self._units), {}
        for unit in new:
            stem = unit.rstrip(string.punctuation)
            if stem.isalpha() and max(stem) < _LATIN_END:
                stems[unit] = stem
        plain = list(set(stems.values()).difference(self._units))  # with their space one pre-token each
        self._units.update(zip(plain, self._merged([" " + u for u in plain]), strict=True))
        cut = {u: self._pattern.findall(" " + u) for u in new.difference(stems)}
        self._learn_words({u[len(x) :] for u, x in stems.items() if u != x}.union(chain.from_iterable(cut.values())))
        for unit, stem in stems.items():
            if unit != stem:
                self._units[unit] = self._units[stem] + self._words[unit[len(stem) :]]
        for unit, words in cut.items():
            self._units[unit] = b"".join(map(self._words.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        found, parts = self._pattern.finditer(text), []
        while words := [m[0] for m in islice(found, _RUN)]:
            self._learn_words(set(words))
            parts.append(b"".join(map(self._words.__getitem__, words)))
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        units = [t.split(" ") if self._split and not any(pair in t for pair in _PAIRS) else None for t in texts]
        self._learn_units(set(chain.from_iterable(u[1:] for u in units if u)))
        out = []
        for text, parts in zip(texts, units, strict=True):
            if parts is None:
                out.append(self._plain(text))
            else:
                out.append(self._plain(parts[0]) + b"".join(map(self._units.__getitem__, parts[1:])))
        return out


def check_split(pattern: str) -> None:
    """Raises where the pattern does not cut probe texts as ``split_at_spaces`` states."""
    import regex

    cut = regex.compile(pattern).findall
    parts = ["a", "Word", "don't", "I'LL", "x1", "12", "1234", "é", "naïve", "ß", "日本", "слово", "ا", "_", "-", "--", "...", "(a)", "a.b", "#!", "'s", "'", "\n", "a\n", "\nb", "\t", "\r\n", "", "😀", "e\u0301", "½", "a\u00a0b"]
    for text in (f"{a} {b}{c} {d}" for k, a in enumerate(parts) for b in parts for c, d in [(parts[(k * 7 + 3) % len(parts)], parts[(k * 11 + 5) % len(parts)])]):
        if any(pair in text for pair in _PAIRS):
            continue
        first, *units = text.split(" ")
        if cut(text) != cut(first) + [t for u in units for t in cut(" " + u)]:
            raise ValueError(f"the pattern does not start a pre-token at each space: {text!r}")
    for stem in (p for p in parts if p.isalpha() and max(p) < _LATIN_END):
        for end in ["", *string.punctuation, "?!", ").", "'s"]:
            rest = end.lstrip(string.ascii_letters)
            if end == rest and cut(" " + stem + end) != [" " + stem, *cut(end)]:
                raise ValueError(f"the pattern does not part letters from punctuation: {stem + end!r}")


_workers: dict[tuple, Encoder] = {}


def _worker(tokens: list[bytes], model: bytes, pattern: str, split_at_spaces: bool) -> Encoder:
    key = (hash(model), pattern, split_at_spaces)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(tokens, model, pattern, split_at_spaces)
    return _workers[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", split_at_spaces: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` of every row's whole text.

    ``ranks`` is the content of a rank file, a bounded vocabulary that is broadcast; see ``Encoder`` for
    ``split_at_spaces``.
    """
    tokens = read_ranks(ranks)
    if split_at_spaces:
        check_split(pattern)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, model_from_ranks(tokens), pattern, split_at_spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(*shared.value)
        for batch in batches:
            for low, high in _text.spans(batch.column(1)):
                part = batch.slice(low, high - low)
                found = worker.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())], names=[id_col, "ids", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, valid_text(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """The rows with ``decoded`` (binary), the bytes that ``ids`` stand for; null ids give empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            for low, high in _text.spans(batch.column("ids")):
                part = batch.slice(low, high - low)
                texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.select(*kept).mapInArrow(run, f"{schema}, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    done = decode(encode(read_texts(spark, sf_dir), ranks, public_tokenizers.PATTERN, split_at_spaces=True), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
