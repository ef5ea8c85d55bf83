"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Merging can only reach back a bounded way. Say two texts share a prefix. Where
their merges first differ is the end of the prefix; a rule (u, v) moves that
place left by len(u), and only if v begins there, so v must have the left part
of the rule before on its leftmost spine, at a later rank. The heaviest chain of
such rules is the merge list's sufficient lookahead: tokens that end further
than that from the end of what has been read stay as they are whatever follows.
A long piece is therefore encoded window by window, and a token is emitted as
soon as it is stable; between windows only the unstable rest is kept.

Texts are cut before white space that follows a non-space, where a piece always
ends. The decoder takes ids one by one, keeps the bytes of an unfinished
character, and writes U+FFFD for bytes that are none.

Null texts are empty and give no ids. Strings of special tokens in a text become
those tokens, as the tokenizer file's ``added_tokens`` ask. Rows are independent,
so ties, repeats and empty tables need no rule; other columns are left out.
"""
from __future__ import annotations

import codecs
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm.common import adding, texts, with_columns

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the tokenizer's own pattern
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0D\x20A-Za-z0-9]+|[\x09-\x0D\x20]+(?![^\x09-\x0D\x20])|[\x09-\x0D\x20]+"  # what it matches in texts without other characters
BLOCK = 1 << 16  # characters that are split at a time
CACHED = 1 << 18  # pieces in each of the two generations that a worker remembers
SHIFT = 24  # bits of an id in the key of a pair
CACHED_CHARS = 32
LONG_PIECE = 48  # tokens from which merging keeps a heap
WINDOW = 2048  # bytes beyond the lookahead that a long piece is read in
OUT_TOKENS = 1 << 18  # tokens a batch of results holds at least before it is sent


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Merge list, lookahead and tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(signs[c] for c in t) for t, i in vocab.items() if all(c in signs for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[c] for _, c in sorted((b, c) for c, b in signs.items())]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << SHIFT | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lookahead = sufficient_lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], self.bytes_of)
        self.pieces, self.ascii_pieces = regex.compile(PIECES), re.compile(ASCII_PIECES)
        self.cut = regex.compile(r"(?<=\S)\s")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a short piece: the pair of lowest rank first, leftmost first among equals."""
        if len(ids) > LONG_PIECE:
            return self.merged_long(ids)
        rank_of, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank_of(a << SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << SHIFT | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << SHIFT | ids[i + 1], none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) over a linked list."""
        rank_of, made, n = self.ranks.get, self.made, len(ids)
        ids, after, before = [*ids, -1], [*range(1, n + 1), n], [*range(-1, n)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:n])) if (rank := rank_of(a << SHIFT | b)) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (rank := rank_of(ids[i] << SHIFT | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = made[rank], -1
            after[i] = after[j]
            before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [i for i in ids if i >= 0]

    def streamed(self, data: bytes) -> Iterator[int]:
        """Tokens of one long piece, each emitted once nothing that follows can change it."""
        first, size = self.first, self.lookahead + WINDOW
        start = 0
        while len(data) - start > size:
            ids = self.merged([first[b] for b in data[start:start + size]])
            end, stable = 0, size - self.lookahead
            for i in ids:
                length = len(self.bytes_of[i])
                if end + length > stable:
                    break
                end += length
                yield i
            start += end
        yield from self.merged([first[b] for b in data[start:]])

    def piece(self, piece: str) -> bytes:
        """Tokens of one piece as packed int32. Short ones are remembered, in two generations, so that frequent ones stay when one is full."""
        if len(piece) > CACHED_CHARS:
            return np.fromiter(self.streamed(piece.encode()), np.int32).tobytes()
        found = self.earlier.get(piece)
        if found is None:
            ids = self.merged([self.first[b] for b in piece.encode()])
            found = pack(f"{len(ids)}i", *ids)
        if len(self.recent) >= CACHED:
            self.earlier, self.recent = self.recent, {}
        self.recent[piece] = found
        return found

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a text that can be split into pieces one after the other."""
        start = 0
        while len(text) - start > BLOCK:
            at = self.cut.search(text, start + BLOCK)
            if not at:
                break
            yield text[start:at.start()]
            start = at.start()
        yield text[start:]

    def packed(self, text: str) -> Iterator[bytes]:
        """Token ids of a text as packed int32, block by block."""
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                yield pack("i", self.special[part])
                continue
            for block in self.blocks(part):
                pieces = self.ascii_pieces if block.isascii() else self.pieces
                if len(block) > 2 * BLOCK:  # white space is far away: go piece by piece
                    for found in pieces.finditer(block):
                        yield self.recent.get(found.group()) or self.piece(found.group())
                    continue
                seen = self.recent
                yield b"".join([seen.get(p) or self.piece(p) for p in pieces.findall(block)])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        return np.frombuffer(b"".join(self.packed(text)), np.int32)

    def decode(self, ids: list[int], step: int = 1 << 14) -> str:
        """The text of a list of ids; bytes of an unfinished character wait for the next step."""
        state, bytes_of, out = codecs.getincrementaldecoder("utf-8")("replace"), self.table.__getitem__, []
        for at in range(0, len(ids), step):
            out.append(state.decode(b"".join(map(bytes_of, ids[at:at + step]))))
        return "".join([*out, state.decode(b"", True)])


def sufficient_lookahead(rules: list[tuple[int, int, int]], bytes_of: dict[int, bytes]) -> int:
    """Bytes after which what follows cannot change a token; rules are (left, right, merged) by rank."""
    made: dict[int, int] = {}
    heaviest: dict[int, int] = {}
    most = 0
    for left, right, merged in rules:
        spine, weight = right, 0
        while spine is not None:
            weight = max(weight, heaviest.get(spine, 0))
            spine = made.get(spine)
        weight += len(bytes_of[left])
        heaviest[left] = max(heaviest.get(left, 0), weight)
        made.setdefault(merged, left)
        most = max(most, weight)
    return most + max(map(len, bytes_of.values()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded_schema(keep_text: bool) -> StructType:
    text = [StructField("text", StringType())] if keep_text else []
    return StructType([StructField("doc_id", LongType()), *text, StructField("ids", ArrayType(IntegerType()))])


def encoder(path: str, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``encode`` does with batches of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            first, found, size = 0, [], 0
            for at, text in enumerate(batch.column("text")):
                ids = pa.array(own.encode(text.as_py()))
                found.append(ids)
                size += len(ids)
                if size >= OUT_TOKENS:
                    yield packed(batch.slice(first, at + 1 - first), found)
                    first, found, size = at + 1, [], 0
            if found:
                yield packed(batch.slice(first), found)

    def packed(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        ends = list(itertools.accumulate((len(i) for i in found), initial=0))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found))
        columns = {"doc_id": part.column("doc_id"), "text": part.column("text")} if keep_text else {"doc_id": part.column("doc_id")}
        return pa.RecordBatch.from_arrays([*columns.values(), ids], names=[*columns, "ids"])

    return run


def decoder(path: str) -> Callable[[pa.RecordBatch], list]:
    """What ``decode`` computes of a batch with ``ids``."""
    def compute(batch: pa.RecordBatch) -> list:
        own = tokenizer(path)
        return [[own.decode(ids.values.to_numpy().tolist()) for ids in batch.column("ids")]]

    return compute


DECODED = StructField("decoded", StringType())


def encode(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """(doc_id, ids), and text if asked: the token ids of every text. ``path`` is a tokenizer file that every executor has."""
    return texts(docs).mapInArrow(encoder(path, keep_text), encoded_schema(keep_text))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``."""
    return with_columns(encoded, [DECODED], decoder(path))


def encode_and_decode(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """``decode`` of ``encode``, batch by batch in one worker a task: one tokenizer in memory in place of two, and ids are not sent twice."""
    schema = StructType([*encoded_schema(keep_text).fields, DECODED])
    encoding, decoding = encoder(path, keep_text), adding(schema, decoder(path))
    return texts(docs).mapInArrow(lambda batches: decoding(encoding(batches)), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every text's ids and what they decode to, as counts and digests."""
    both = encode_and_decode(docs, path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
