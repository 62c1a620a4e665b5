"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from winnow.functions.partitions import spread
from winnow.functions.workers import kept

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBERED = 1_000_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself if printable in Latin-1, else the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids from a file of base64 tokens and ranks."""
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a length-delimited one for bytes, a varint for an int, 32 bits for a float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value & (2**64 - 1))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the given tokens.

    Piece i is token i, its bytes as letters, its score -i, so that the merge of the lowest rank wins.
    One further piece stands for the unknown.  Nothing is normalised, added or escaped.
    """
    letters = byte_letters()
    by_id = sorted(ranks.items(), key=lambda kv: kv[1])
    if [i for _, i in by_id] != list(range(len(by_id))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-i)) + _field(3, normal))
        for token, i in by_id
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = b"".join(
        (
            _field(3, bpe),  # model_type
            _field(4, len(pieces)),  # vocab_size
            _field(40, len(by_id)),  # unk_id
            _field(41, -1),  # no sentence start
            _field(42, -1),  # no sentence end
            _field(43, -1),  # no padding
        )
    )
    normalizer = b"".join(
        (_field(1, b"identity"), _field(3, 0), _field(4, 0), _field(5, 0))
    )  # no prefix, blanks kept, not escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts to ids and back; equal pre-tokens are encoded once."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self._tokens = [t for t, _ in sorted(ranks.items(), key=lambda kv: kv[1])]
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        self._split = regex.compile(PATTERN).findall
        self._known: dict[str, list[int]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self._known) + len(words) > REMEMBERED:
            self._known.clear()
        order = list(words)
        mapped = ["".join(map(self._letters.__getitem__, w.encode("utf-8", "surrogatepass"))) for w in order]
        self._known.update(zip(order, self._processor.encode(mapped, num_threads=1), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; no ids for an empty or a null text."""
        out = []
        known = self._known
        for text in texts:
            words = self._split(text) if text else []
            try:
                parts = [known[w] for w in words]
            except KeyError:
                self._learn({w for w in words if w not in known} if len(known) < REMEMBERED else set(words))
                if not all(w in known for w in set(words)):  # what was known was cleared
                    self._learn(set(words))
                parts = [known[w] for w in words]
            out.append(list(chain.from_iterable(parts)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return b"".join(self._tokens[i] for i in ids).decode("utf-8", "surrogatepass")


def encode(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) for every row: the ids of the text, unchanged, without special tokens.

    ``tokenizer`` is the path of a file of base64 tokens and ranks; it travels with the job.  The
    vocabulary becomes a sentencepiece model, whose merges are those of the byte-level BPE.  Strings of
    special tokens in a text are ordinary text.

    Defined cases: an empty and a null text give an empty list, a text of blanks is encoded like any
    other; a null key stays null; repeated rows give repeated rows; a text of any length is encoded
    whole; an empty table gives an empty result; other columns are ignored.
    """
    context = df.sparkSession.sparkContext
    context.addFile(tokenizer)
    name = Path(tokenizer).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        state = Path(path).stat()  # another file of the same name is another vocabulary
        encoder = kept(("encoder", path, state.st_size, state.st_mtime_ns), lambda: Encoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = encoder.encode(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                values = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
