"""Blocks of documents, whose distinct words travel once a block while their positions stay with the block.

A word that occurs in a third of all documents costs one row a block, not one row an occurrence, so no key of the
word shuffle is hot; a block is bounded by its bytes (one longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

ROWS = 1 << 14
REPLY = pa.schema([("block", pa.int64()), ("reply", pa.binary()), ("body", pa.binary())])


class Block:
    """Documents in order: their keys, the numbers of their words, and the distinct words in order, by number.

    numbers and counts are None where only the distinct words were asked for.
    """

    def __init__(self, name: int, keys: pa.Array, counts: np.ndarray | None, numbers: np.ndarray | None, words: list | None, n_words: int, extra: dict[str, np.ndarray]):
        self.name, self.keys, self.counts, self.numbers, self.words, self.n_words, self.extra = name, keys, counts, numbers, words, n_words, extra

    def documents(self) -> Iterator[np.ndarray]:
        """The word numbers of each document."""
        return iter(np.split(self.numbers, np.cumsum(self.counts)[:-1]) if len(self.counts) else [])

    def word_rows(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(block, number, word) and the named columns, a row a distinct word."""
        for at in range(0, self.n_words, ROWS):
            stop = min(at + ROWS, self.n_words)
            arrays = [pa.array(np.full(stop - at, self.name, np.int64)), pa.array(np.arange(at, stop, dtype=np.int32)), pa.array(self.words[at:stop])]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(c[at:stop]) for c in columns.values()], ["block", "number", "word", *columns]
            )

    def word_packs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """(block, shard, pack): the distinct words in packs, one for each shard that has some of them."""
        raw = [w.encode() if isinstance(w, str) else w for w in self.words]
        shard = np.fromiter(map(xxhash.xxh32_intdigest, raw), np.uint32, len(raw)) % np.uint32(shards)
        order = np.argsort(shard, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order)) if len(order) else np.zeros(1, int)
        for at in range(0, len(edges) - 1, 64):
            parts = [order[i:j] for i, j in zip(edges[at : at + 64], edges[at + 1 : at + 65])]
            packs = [shut_pack(p, [raw[i] for i in p]) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), self.name)), pa.array(shard[[p[0] for p in parts]].astype(np.int64)), pa.array(packs, pa.binary())], ["block", "shard", "pack"])

    def ragged(self, table: pa.Table, unit: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What came back for the words: all values in one array, and by number their starts and sizes in it.

        Equal blocks get a word as often as there are such blocks; the first is taken.
        """
        replies = [open_reply(r.as_buffer()) for r in table.column("reply") if r.is_valid]
        numbers = np.concatenate([r[0] for r in replies] or [np.zeros(0, np.int32)])
        sizes = np.concatenate([r[1] for r in replies] or [np.zeros(0, np.int64)]).astype(np.int64)
        flat = np.concatenate([np.frombuffer(r[2], unit) for r in replies] or [np.zeros(0, unit)])
        distinct, order = np.unique(numbers, return_index=True)
        if len(distinct) != self.n_words or len(numbers) % max(1, self.n_words):
            raise ValueError(f"block {self.name}: {len(distinct)} of {self.n_words} words came back; the input changed between two reads")
        sizes //= unit.itemsize
        return flat, (np.cumsum(sizes) - sizes)[order], sizes[order]


def shut_pack(numbers: np.ndarray, words: list[bytes]) -> bytes:
    """Words and their rising numbers, compressed."""
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    raw = np.array([len(words)], "<i8").tobytes() + np.diff(numbers, prepend=0).astype("<i4").tobytes() + sizes.tobytes() + b"".join(words)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def open_packs(packs: list[pa.Buffer]) -> tuple[list[np.ndarray], pa.Array]:
    """The numbers in each pack, and the words of all packs one after the other."""
    opened = [open_reply(p) for p in packs]
    sizes = np.concatenate([o[1] for o in opened])
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(o[2] for o in opened))])
    return [o[0] for o in opened], words


class Replies:
    """What a task has for the words of each block, sent as one compressed row a block: (block, reply, null)."""

    def __init__(self, rows: int = 200_000):
        self.rows, self.held, self.parts = rows, 0, []

    def add(self, blocks: pa.Array, numbers: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        self.parts.append(pa.table({"block": blocks, "number": numbers, "value": values}))
        self.held += len(blocks)
        if self.held >= self.rows:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        table = pa.concat_tables(self.parts).combine_chunks().sort_by([("block", "ascending"), ("number", "ascending")])
        self.parts, self.held = [], 0
        names, starts = np.unique(table.column("block").to_numpy(), return_index=True)
        ends = np.append(starts[1:], table.num_rows)
        replies = []
        for a, b in zip(starts, ends, strict=True):
            part = table.slice(a, b - a)
            values = pa.concat_arrays(part.column("value").chunks)
            offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            data = values.buffers()[2]
            body = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b""
            numbers = np.diff(part.column("number").to_numpy(), prepend=0).astype("<i4")
            raw = np.array([len(numbers)], "<i8").tobytes() + numbers.tobytes() + np.diff(offsets).astype("<i4").tobytes() + body
            replies.append(np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(replies, pa.binary()), pa.nulls(len(names), pa.binary())], ["block", "reply", "body"])


def open_reply(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Numbers, sizes in bytes, and the values' bytes, of one reply."""
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], "<i8")[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<i4", n, 8), dtype=np.int32), np.frombuffer(raw, "<i4", n, 8 + 4 * n), raw[8 + 8 * n :]


def ragged_places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for sizes[0] places, then the same from begins[1], and so on."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Numbers(dict):
    """Words to numbers by first use; add() gives a text's numbers. Subclasses say how a text is cut."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n

    def distinct(self) -> list:
        return list(self)


def cut(batches: Iterator[pa.RecordBatch], start: Callable, block_bytes: int, beside: tuple[str, ...] = ()) -> Iterator[Block]:
    """Blocks of about block_bytes of text from batches of (key, text) and the columns `beside`, which go to extra.

    start() makes a block's gatherer: add(text) takes in a text and gives its words' numbers, or None where they aren't
    wanted; distinct() lists the words, by number if there are numbers.
    A block is named by a hash of its keys and texts, so each pass over the same rows gives it the same name; blocks
    that are equal throughout share a name, and copies() says how many there are.
    """
    words = start()
    keys, more, counts, numbers, size, mark = [], [], [], [], 0, xxhash.xxh64()

    def shut() -> Block:
        names, flat, sizes = words.distinct(), None, None
        if numbers[0] is None:
            names.sort()
        else:
            order = sorted(range(len(names)), key=names.__getitem__)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            names, flat, sizes = [names[i] for i in order], place[np.concatenate(numbers)], np.array(counts, np.int64)
        extra = {c: pa.concat_arrays([m[i] for m in more]).to_numpy(zero_copy_only=False) for i, c in enumerate(beside)}
        return Block(mark.intdigest() - (1 << 63), pa.concat_arrays(keys), sizes, flat, names, len(names), extra)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            texts, names, first = piece.column("text").to_pylist(), piece.column("key").to_pylist(), 0
            for row, text in enumerate(texts):
                got = words.add(text)
                numbers.append(got)
                counts.append(0 if got is None else len(got))
                raw = text.encode()
                mark.update(f"{names[row]} {len(raw)} ".encode() + raw)
                size += len(raw)
                last = row + 1 == len(texts)
                if size >= block_bytes or last:
                    part = piece.slice(first, row + 1 - first)
                    keys.append(part.column("key"))
                    more.append([part.column(c) for c in beside])
                    first = row + 1
                if size >= block_bytes:
                    yield shut()
                    words = start()
                    keys, more, counts, numbers, size, mark = [], [], [], [], 0, xxhash.xxh64()
    if counts:
        yield shut()


#: So many of a block's words get short codes, by falling frequency.
SHORT = 1 << 16


def shut_block(block: Block, **extra: np.ndarray) -> pa.RecordBatch:
    """The block without its words as one row (block, null, body), compressed."""
    used = np.bincount(block.numbers, minlength=block.n_words)
    top = np.argsort(-used, kind="stable")[:SHORT].astype(np.int32)
    codes = np.empty(block.n_words, "<u4")
    codes[_by_code(top, block.n_words)] = np.arange(block.n_words)
    planes = codes[block.numbers].view(np.uint8).reshape(-1, 4)
    heads = {"key": block.keys, "counts": pa.array(block.counts), **{k: pa.array(v) for k, v in extra.items()}}
    sink = pa.BufferOutputStream()
    for columns in (heads, {"top": pa.array(top)}, {f"plane{i}": pa.array(np.ascontiguousarray(planes[:, i])) for i in range(4)}):
        table = pa.table(columns).replace_schema_metadata({"words": str(block.n_words)})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
    body = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([block.name], pa.int64()), pa.nulls(1, pa.binary()), body], ["block", "reply", "body"])


def _by_code(top: np.ndarray, n: int) -> np.ndarray:
    """Word numbers in order of their codes: the top ones, then the others as they are."""
    rest = np.ones(n, bool)
    rest[top] = False
    return np.concatenate([top, np.flatnonzero(rest).astype(np.int32)])


def copies(table: pa.Table) -> int:
    """How many equal blocks a group has."""
    return table.num_rows - table.column("body").null_count


def open_block(table: pa.Table) -> Block:
    """The block of a group of rows, from a row that has a body."""
    bodies = table.filter(table.column("body").combine_chunks().is_valid())
    if not bodies.num_rows:
        raise ValueError("words of a block without its body: the input changed between two reads")
    source = pa.BufferReader(bodies.column("body")[0].as_buffer())
    heads, top, planes = (pa.ipc.open_stream(source).read_all() for _ in range(3))
    n_words = int(heads.schema.metadata[b"words"])
    codes = np.empty((planes.num_rows, 4), np.uint8)
    for i in range(4):
        codes[:, i] = planes.column(f"plane{i}").to_numpy()
    numbers = _by_code(top.column("top").to_numpy(), n_words)[codes.view("<u4").ravel()] if n_words else np.zeros(0, np.int32)
    keys = pa.concat_arrays(heads.column("key").chunks)
    extra = {c: heads.column(c).to_numpy() for c in heads.column_names if c not in ("key", "counts")}
    return Block(table.column("block")[0].as_py(), keys, heads.column("counts").to_numpy(), numbers, None, n_words, extra)
