"""Byte-level byte-pair encoding: ranks, the two merge loops, and the cuts that come before the merges.

Encoding shuffles distinct pre-tokens of the whole corpus: documents are gathered into blocks, each block sends every
distinct pre-token it holds once, a pre-token is encoded once where all blocks' packs with it meet, and the ids go back to
their block, where the stored positions put them in order. Decoding joins ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.blocks import REPLY, Numbers, Replies, copies, cut, open_block, open_packs, ragged_places, shut_block
from docweft.llm.common import keyed, text_pass

#: Where a text may be cut so that its pieces' pre-tokens are those of the whole: before a space that a non-space follows.
_CUT, _ODD_SPACE = regex.compile(r" (?=\S)"), re.compile(r" (?=\s|$)")

#: Marks that are a pre-token of their own after letters.
_MARKS = frozenset(".,;:!?")


def pieces(text: str) -> list[str]:
    """The text cut before each single space that starts a word; all but the first lack that space."""
    return _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in .json vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """Pairs of token bytes to merge rank, and the special strings, from a .json file of a byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}, tuple(t["content"] for t in data["added_tokens"])


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: itself if it has a rank, else merge the adjacent pair of the lowest rank until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts, top, get = [word[i : i + 1] for i in range(len(word))], len(ranks) + 1, ranks.get
    if len(word) > 200:
        return [ranks[p] for p in _heap_merge(parts, lambda a, b: get(a + b))]
    scores = [get(a + b, top) for a, b in zip(parts, parts[1:], strict=False)]
    while scores and (low := min(scores)) < top:
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], top)
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], top)
    return [ranks[p] for p in parts]


def _heap_merge(parts: list[bytes], rank_of) -> list[bytes]:
    """The symbols left when adjacent pairs are merged, lowest rank first and leftmost among equals.

    parts is a linked list by index (`after`, `before`); the heap holds (rank, left index, both symbols), and an entry
    whose symbols have changed meanwhile is stale.
    """
    symbols: list[bytes | None] = list(parts)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i) for i in range(len(parts) - 1) if (r := rank_of(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= len(symbols) or rank_of(symbols[i], symbols[j]) != rank:
            continue
        symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], None, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
            if (r := rank_of(symbols[i], symbols[after[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := rank_of(symbols[before[i]], symbols[i])) is not None:
            heapq.heappush(heap, (r, before[i]))
    return [s for s in symbols if s is not None]


def heap_count(word: bytes, merges: dict[tuple[bytes, bytes], int]) -> int:
    """Tokens of one pre-token: its bytes less the merges; pairs pop off a heap, symbols form a linked list.

    Only lengths of the symbols are kept beside their start, so nothing is rebuilt and no id is made.
    """
    n = len(word)
    if n < 2:
        return n
    get, end, after, before = merges.get, list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
    heapq.heapify(heap)
    count, gone = n, [False] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        count -= 1
        gone[j], end[i], after[i] = True, stop, after[j]
        left = word[i:stop]
        if stop < n:
            k = stop
            before[k] = i
            if (r := get((left, word[k : end[k]]))) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := get((word[h:i], left))) is not None:
            heapq.heappush(heap, (r, h, stop))
    return count


class Cache(dict):
    """Values computed on first use; emptied when `most` keys are held, so a worker's memory stays bounded."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    """text -> number of tokens; a special string is one token, as the library takes it by default."""
    merges, special = load_merges(path)
    cut_piece = pretokens_of_piece(pattern)
    of_word = Cache(lambda w: heap_count(w.encode(), merges))
    of_first = lambda p: sum(map(of_word.__getitem__, cut_piece(p)))
    of_piece = Cache(lambda p: of_first(" " + p))
    at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> int:
        first, *rest = pieces(text)
        return of_first(first) + sum(map(of_piece.__getitem__, rest))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if at_special and any(s in text for s in special):
            parts = at_special.split(text)
            return len(parts) - 1 + sum(plain(p) for p in parts if p)
        return plain(text)

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row: tokens of the whole text by the vocabulary at path (.json).

    A pre-token counts as its bytes less the merges that heap and linked list make; counts of distinct pre-tokens are
    kept in a bounded cache of the worker. Null and empty texts have 0 tokens; repeated rows and null keys come out as
    they came in; an empty table gives no rows.
    """

    def each(texts):
        count = counter(path, pattern)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    out = text_pass(keyed(docs, key, text), fields, each)
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def pretokens_of_piece(pattern: str):
    """A piece, with its space, to its pre-tokens; letters alone, and letters before one mark, need no matching."""
    match = regex.compile(pattern).findall

    def cut_piece(piece: str) -> list[str]:
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isalpha():
            return [piece]
        if bare[-1:] in _MARKS and bare[:-1].isalpha():
            return [piece[:-1], bare[-1]]
        return match(piece)

    return cut_piece


class PieceNumbers(dict):
    """A piece that had a space before it to its pre-tokens' numbers; emptied at `most` pieces."""

    def __init__(self, words: Numbers, match, most: int = 60_000):
        self.words, self.match, self.most = words, match, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        words = self.words
        if piece.isalpha():
            out = (words[" " + piece],)
        elif piece[-1:] in _MARKS and piece[:-1].isalpha():
            out = words[" " + piece[:-1]], words[piece[-1]]
        else:
            out = tuple(map(words.__getitem__, self.match(" " + piece)))
        if len(self) >= self.most:
            self.clear()
        self[piece] = out
        return out


class PreTokens(Numbers):
    """A text's pre-tokens."""

    def __init__(self, pattern: str):
        self.match = regex.compile(pattern).findall
        self.of_piece = PieceNumbers(self, self.match)

    def add(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        first, *rest = pieces(text)
        return np.fromiter(chain(map(self.__getitem__, self.match(first)), chain.from_iterable(map(self.of_piece.__getitem__, rest))), np.int32)


class DistinctPreTokens:
    """The distinct pre-tokens of texts alone: pieces are told apart first, and each is cut once."""

    def __init__(self, pattern: str):
        self.cut_piece, self.first, self.rest = pretokens_of_piece(pattern), set(), set()

    def add(self, text: str) -> None:
        if text:
            first, *rest = pieces(text)
            self.first.add(first)
            self.rest.update(rest)

    def distinct(self) -> list[str]:
        found, cut_piece = set(), self.cut_piece
        while self.first:
            found.update(cut_piece(self.first.pop()))
        while self.rest:
            found.update(cut_piece(" " + self.rest.pop()))
        return list(found)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", block_bytes: int = 1 << 23, shard_bytes: int = 1 << 23,
    decode: bool = False,
) -> DataFrame:
    """(key, n_tokens, ids) for every row: ids by the ranks at path (.tiktoken), as little-endian unsigned 32-bit integers.

    With decode, decoded too: what decode_documents() makes of the ids, in the worker that puts them together, so that a
    task has one worker and not two.

    docs must be a stored table or another input whose rows don't change between two reads: its pre-tokens and their
    positions are two passes over it. (Blocks are named by their content; should a read differ, the job fails and does
    not mix them up.) Distinct pre-tokens are dealt by their hash to shards, one for each shard_bytes of text, in packs of
    one block and one shard: a task that encodes holds one shard. Null and empty texts have no ids; repeated rows and null
    keys come out as they came in; an empty table gives no rows; a very long text is a block of its own.
    """
    rows = keyed(docs, key, text)
    key_type = rows.schema["key"].dataType
    unit = np.dtype("<u2" if len(load_ranks(path)) <= 1 << 16 else "<u4")
    shards = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches, lambda: DistinctPreTokens(pattern), block_bytes):
            yield from block.word_packs(shards)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches, lambda: PreTokens(pattern), block_bytes):
            yield shut_block(block)

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        numbers, met = open_packs([p.as_buffer() for p in table.column("pack")])
        distinct, ranks = met.dictionary_encode(), load_ranks(path)
        made = pa.array([np.array(encode_word(w, ranks), unit).tobytes() for w in distinct.dictionary.to_pylist()], pa.binary()).take(distinct.indices)
        blocks = pa.array(np.repeat(table.column("block").to_numpy(), [len(n) for n in numbers]))
        replies = Replies(len(made) + 1)
        return pa.Table.from_batches([*replies.add(blocks, pa.array(np.concatenate(numbers)), made), *replies.rest()], REPLY)

    met = rows.mapInArrow(words, "block long, shard long, pack binary")
    encoded = met.groupBy("shard").applyInArrow(encode, "block long, reply binary, body binary")
    order = rows.mapInArrow(orders, "block long, reply binary, body binary")

    def assemble(table: pa.Table) -> pa.Table:
        block = open_block(table)
        flat, begins, sizes = block.ragged(table, unit)
        ids, counts, decoded = [], [], []
        for numbers in block.documents():
            n = sizes[numbers]
            ids.append(flat[ragged_places(begins[numbers], n)].astype("<u4").tobytes())
            counts.append(int(n.sum()))
            if decode:
                decoded.append(decoded_ids(ids[-1], path))
        made = {"key": block.keys, "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())}
        out = pa.table({**made, "decoded": pa.array(decoded, pa.binary())} if decode else made)
        # In slices, so that no batch on its way back holds a whole block.
        parts = [b for at in range(0, len(out), 500) for b in out.slice(at, 500).to_batches()]
        return pa.Table.from_batches(parts * copies(table), out.schema)

    bodies = ["ids", "decoded"] if decode else ["ids"]
    schema = T.StructType([T.StructField("key", key_type), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in bodies]])
    out = encoded.unionByName(order).groupBy("block").applyInArrow(assemble, schema)
    return out.withColumnRenamed("key", key)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes in one array, each token's start, each token's length."""
    by_id = {i: b for b, i in load_ranks(path).items()}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    sizes = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def decoded_ids(blob: bytes | None, path: str) -> bytes | None:
    """The bytes of ids, by the token-byte table; null gives null."""
    if blob is None:
        return None
    data, begins, sizes = token_bytes(path)
    out = []
    for at in range(0, len(blob), 1 << 20):
        tokens = np.frombuffer(blob[at : at + (1 << 20)], "<u4")
        n = sizes[tokens]
        out.append(data[ragged_places(begins[tokens], n)].tobytes())
    return b"".join(out)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids added: a map-side join with the token-byte table, as large as the vocabulary.

    Null ids give null. An id outside the vocabulary fails the job.
    """
    kept = encoded.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([decoded_ids(b, path) for b in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*(f.name for f in kept), into])

    return encoded.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.BinaryType())]))
