"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Ranks give the vocabulary; the merges that the library wants are every split of a token into two tokens. Texts are cut
by the pattern into pieces, which are encoded separately: a piece's bytes are mapped to the byte alphabet's characters
and encoded by the library when a worker first meets it, and every text of an Arrow batch is put together from its
pieces, ids and offsets alike. Decoding looks ids up in the reversed byte table, as bytes, so a character whose bytes lie in two tokens
comes out whole; offsets map a token to all characters it touches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import models

from tidewire.llm.common import give_back, text_slices

#: Characters of distinct pieces that a worker keeps between batches; beyond it, it starts afresh (results don't depend on it).
KEPT_CHARS = 3_000_000


def byte_alphabet() -> list[str]:
    """Character of each byte: visible Latin-1 characters stand for themselves, the others take 256, 257, ... in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(visible)))
    return [table[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def latin1_pattern(pattern: str) -> re.Pattern:
    """A pattern of the standard library that matches as `pattern` does in texts of characters below U+0100.

    \\p{L}, \\p{N}, \\s and \\S become the characters below U+0100 that they stand for, which is much faster to match.
    """
    chars = [chr(i) for i in range(256)]
    members = {kind: "".join(re.escape(c) for c in chars if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        kind = next((k for k in (*members, r"\S") if pattern.startswith(k, i)), None)
        if kind == r"\S" and not inside:
            out.append(f"[^{members[chr(92) + 's']}]")
        elif kind in members:
            out.append(members[kind] if inside else f"[{members[kind]}]")
        elif kind or pattern[i] == "\\" and pattern[i + 1 : i + 2] in "pPwWdDbB":
            raise ValueError(f"no Latin-1 form of {pattern!r}")
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
        i += len(kind) if kind else 1
    return re.compile("".join(out))


class _Pieces(dict):
    """piece -> what `make` makes of it, made at the first look."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.make(piece)
        return found


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        letters = byte_alphabet()
        name = lambda token: token.decode("latin-1").translate("".join(letters))
        names = {token: name(token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            splits = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(names[token[:i]], names[token[i:]]) for _, _, i in sorted(splits)]
        self.model = models.BPE(vocab={names[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        del merges, names
        self.letters = "".join(letters)
        self.pattern, self.narrow = regex.compile(pattern), latin1_pattern(pattern)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_length = lengths
        self.token_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.kept = 0
        self.ids_of = _Pieces(self._encode_piece)
        self.text_of = _Pieces(lambda piece: ",".join(map(str, np.frombuffer(self.ids_of[piece], np.int32).tolist())))

    def _encode_piece(self, piece: str) -> bytes:
        """int32 ids of a piece, whose UTF-8 bytes go to the library as characters of the byte alphabet."""
        self.kept += len(piece) + 16
        written = piece.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(written)]).tobytes()

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.kept > KEPT_CHARS:
            self.ids_of.clear()
            self.text_of.clear()
            self.kept = 0
        return (self.narrow if text.isascii() or max(text) < "\u0100" else self.pattern).findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, self.pieces(text))), np.int32)

    def digest(self, text: str) -> tuple[np.ndarray, str, str]:
        """Ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes that the ids decode to."""
        found = self.pieces(text)
        ids = np.frombuffer(b"".join(map(self.ids_of.__getitem__, found)), np.int32)
        written = ",".join(map(self.text_of.__getitem__, found)).encode()
        return ids, hashlib.sha256(written).hexdigest(), hashlib.sha256(self.decode_bytes(ids)).hexdigest()

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in characters of every token; a token that holds part of a character covers the whole of it."""
        lengths = self.token_length[self.encode(text)]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        of_byte = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1 if text else np.zeros(0, np.int64)
        return [(int(of_byte[a]), int(of_byte[b - 1]) + 1) for a, b in zip(starts, ends)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.token_length[ids]
        ends = np.cumsum(lengths)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        return self.token_bytes[np.repeat(self.token_start[ids], lengths) + within].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 (a list cut within a character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_worker: dict[tuple[str, str], ByteBpe] = {}


def bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder of this worker; built once for a file and pattern."""
    if (path, pattern) not in _worker:
        _worker[path, pattern] = ByteBpe(load_ranks(path), pattern)
        give_back()
    return _worker[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents (doc_id, text) -> doc_id, ids (array of int), starts, ends (characters); null texts count as empty.

    Repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for b in text_slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            spans = [own.offsets(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([own.encode(t).tolist() for t in texts], pa.list_(pa.int32())), *[pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in (0, 1)]],
                ["doc_id", "ids", "starts", "ends"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _lists(values: list[np.ndarray]) -> pa.Array:
    """array<int> from one array a row, without Python objects for the values."""
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def encode_digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids), encoded and decoded in one pass.

    The digests are of the decimal ids joined by commas and of the bytes that those ids decode to. Null texts count as
    empty. Repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for b in text_slices(batches):
            ids, ids_sha, text_sha = zip(*[own.digest(t or "") for t in b.column("text").to_pylist()])
            made = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*made, _lists(list(ids))], [*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(made, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
