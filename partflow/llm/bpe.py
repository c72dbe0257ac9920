"""Byte-level BPE by a lazily built finite-state transducer, and streaming decoding by an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# What a worker remembers; a full table is emptied and filled anew. Measured with a vocabulary of 50,000 entries, a worker with
# nearly full tables holds some 180 MB.
MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_PIECE_BYTES = 400_000, 1_000_000, 600_000, 24 << 20
ROOT, NONE, NEVER = 0, -1, 1 << 40
LOOKAHEAD = 256  # prefixes kept before it is worth looking for a place to emit
DECODE_IDS = 1 << 16  # ids decoded at a time
ROWS = 256  # rows handed on at a time


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Transducer:
    """Reads bytes and tells for each the token that the encoding of the bytes so far ends in.

    That token begins where a shorter prefix ends. A state holds the places from which some vocabulary entry may still grow:
    the trie node reached from there, and the token that ends there. States and moves are built when first met. Tokens are
    emitted, by stepping back from token to token, once a single place is left, which no later byte can change; how far
    that lies ahead is bounded by the longest entry.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.next: dict[int, int] = {}  # trie node << 8 | byte -> node
        self.token = array("i", [NONE])  # of each node
        self.inner = bytearray(1)  # whether a node has children
        for piece, rank in ranks.items():
            node = ROOT
            for byte in piece:
                grown = self.next.setdefault(node << 8 | byte, len(self.token))
                if grown == len(self.token):
                    self.token.append(NONE)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = grown
            self.token[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}  # state << 8 | byte -> state << 32 | token + 1
        self._state(((ROOT, NONE),))

    def _state(self, state: tuple) -> int:
        at = self.ids.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        return at

    def split(self, token: int) -> tuple[int, int] | None:
        """The halves a token was last merged from; nothing for a byte or an entry that merging its bytes never makes."""
        if token not in self.halves:
            parts, last = [bytes([b]) for b in self.bytes_of[token]], None
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = last if len(parts) == 1 else None
        return self.halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens. Their merges are undone from the latest; the border falls
        if some pair over it would have merged before the merge that was undone last."""
        pair = left << 32 | right
        if pair in self.fits:
            return self.fits[pair]
        a, b, limit, kept = left, right, NEVER, True
        while kept:
            kept = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER) >= limit
            undo_a, undo_b = self.split(a), self.split(b)
            if undo_a is None and undo_b is None:
                break
            if undo_b is None or undo_a is not None and a > b:
                limit, a = a, undo_a[1]  # of merges of one rank the left one comes first, here the one undone
            else:
                limit, b = b + 1, undo_b[0]  # and here the one over the border
        if len(self.fits) >= MAX_PAIRS:
            self.fits.clear()
        self.fits[pair] = kept
        return kept

    def _move(self, at: int, byte: int) -> int:
        grown, ended = [], NONE
        for node, last in self.states[at]:
            node = self.next.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if ended == NONE and token != NONE and (len(self.bytes_of[token]) == 1 or self.split(token) is not None) and (last == NONE or self.apart(last, token)):
                ended = token
            if self.inner[node]:
                grown.append((node, last))
        grown.append((ROOT, ended))
        return self._state(tuple(grown)) << 32 | ended + 1

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(self.states) > MAX_STATES:
            self._forget()
        moves, bytes_of, at = self.moves, self.bytes_of, 0
        out: list[int] = []
        ends: list[int] = []  # the last token of each prefix not yet emitted

        def emit() -> None:
            i, back = len(ends), []
            while i:
                back.append(ends[i - 1])
                i -= len(bytes_of[ends[i - 1]])
            out.extend(reversed(back))
            ends.clear()

        for byte in piece:
            move = moves.get(at << 8 | byte)
            if move is None:
                move = moves[at << 8 | byte] = self._move(at, byte)
            at = move >> 32
            ends.append((move & 0xFFFFFFFF) - 1)
            if len(ends) >= LOOKAHEAD and len(self.states[at]) == 1:
                emit()
        emit()
        return out


class Utf8Stream:
    """Decodes UTF-8 that arrives in pieces: the state is the unfinished character's bytes so far."""

    def __init__(self):
        self.open = b""

    def feed(self, piece: bytes) -> str:
        piece = self.open + piece
        cut = len(piece)
        for back in range(1, min(4, len(piece) + 1)):
            byte = piece[-back]
            if byte >= 0xC0:  # a first byte: is its character whole?
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if size > back:
                    cut = len(piece) - back
                break
            if byte < 0x80:
                break
        self.open = piece[cut:]
        return piece[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


class PieceEncoder(dict):
    """Packed ids of each match of the pattern met so far. Long matches are not remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.machine, self.matches, self.held = Transducer(ranks), regex.compile(pattern), 0

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= LOOKAHEAD:
            self.held += len(piece)
            self[piece] = packed
        return packed

    def encoded(self, text: str | None) -> bytes:
        if len(self) > MAX_PIECES or self.held > MAX_PIECE_BYTES:
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, self.matches.findall(text))) if text else b""

    def decoded(self, packed: bytes | None) -> str:
        return decoded(packed, self.machine.bytes_of)


def decoded(packed: bytes | None, bytes_of: dict[int, bytes]) -> str:
    """The text that packed ids stand for, decoded a bounded number of ids at a time."""
    ids, stream, out = np.frombuffer(packed or b"", "<u4"), Utf8Stream(), []
    for at in range(0, len(ids), DECODE_IDS):
        out.append(stream.feed(b"".join(map(bytes_of.__getitem__, ids[at : at + DECODE_IDS].tolist()))))
    return "".join(out) + stream.close()


@functools.lru_cache(1)
def _entries(content: bytes) -> dict[int, bytes]:
    return {r: b for b, r in parse_ranks(content).items()}


_encoders: dict[tuple[int, str], PieceEncoder] = {}


def _encoder(content: bytes, pattern: str) -> PieceEncoder:
    """One encoder a Python worker, kept between tasks; another vocabulary takes its place."""
    key = (hash(content), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(parse_ranks(content), pattern)
    return _encoders[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def transcode_bpe(docs: DataFrame, rank_file: str, pattern: str, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each text, and `text`, the text decoded from the ids.

    Both directions are one pass with one vocabulary a worker. A null or empty text has no ids and decodes to the empty text.
    rank_file is read once on the driver and sent to the workers: a vocabulary has a fixed size. Rows keep their order and
    number; rows that repeat are encoded alike; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())
    names = ["doc_id", "n_tokens", "ids", *(["text"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            encoder = _encoder(content.value, pattern)
            ids = [encoder.encoded(text.as_py()) for text in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.record_batch(columns + ([pa.array(map(encoder.decoded, ids), pa.string())] if decode else []), names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", text string" if decode else ""))


def encode_bpe(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of each text; see transcode_bpe."""
    return transcode_bpe(docs, rank_file, pattern, decode=False)


def decode_bpe(rows: DataFrame, rank_file: str) -> DataFrame:
    """The columns of rows with ids replaced by the text they stand for, decoded piece by piece; null ids give an empty text."""
    content = rows.sparkSession.sparkContext.broadcast(open(rank_file, "rb").read())
    names = [c for c in rows.columns if c != "ids"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [decoded(packed.as_py(), _entries(content.value)) for packed in batch.column("ids")]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
