"""Byte-pair encoding by a lexicon: a minimal acyclic transducer of frequent words, mapped into memory by the workers.

Pre-tokens are counted over all documents; the most frequent ones are compiled into an automaton that shares prefixes and
suffixes. Each transition gives out a number, and the sum along a word is the word's place in the table of id sequences.
The file goes to the workers through Spark and is mapped, so the workers of a machine share its pages. Words that the
lexicon lacks are merged exactly, so what it holds decides on the time only.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.blocks import Numbers, ragged_places
from docweft.llm.bpe import PieceNumbers, byte_letters, load_merges, pieces, pretokens_of_piece
from docweft.llm.common import keyed, saved, with_checkpoints


SHIFT = 20  #: ids have fewer bits than this


class Vocabulary(NamedTuple):
    """What a byte-level BPE's .json file says: each byte's id, token bytes to id, special strings to id, and the merges.

    merges: the two ids of a pair, side by side in one number, to the pair's rank and the id that it becomes, likewise.
    """

    bytes_: list[int]
    ids: dict[bytes, int]
    merges: dict[int, int]
    special: dict[str, int]
    pattern: str

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token: adjacent pairs are merged, lowest rank first and leftmost among equals, until none is left."""
        symbols, get, none, mask = [self.bytes_[b] for b in word], self.merges.get, len(self.merges) << SHIFT, (1 << SHIFT) - 1
        if len(word) > 100:
            return self._merged(symbols)
        ranks = [get(a << SHIFT | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            symbols[i : i + 2] = [low & mask]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << SHIFT | symbols[i], none)
            if i < len(ranks):
                ranks[i] = get(symbols[i] << SHIFT | symbols[i + 1], none)
        return symbols

    def _merged(self, symbols: list[int]) -> list[int]:
        """The same for long words: a heap of (rank and new id, left place, pair), symbols linked by the places beside them."""
        get, n, mask = self.merges.get, len(symbols), (1 << SHIFT) - 1
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, p) for i in range(n - 1) if (r := get(p := symbols[i] << SHIFT | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] << SHIFT | symbols[j] != pair:
                continue
            symbols[i], gone[j], after[i] = rank & mask, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := get(p := symbols[left] << SHIFT | symbols[right])) is not None:
                    heapq.heappush(heap, (r, left, p))
        return [s for s, out in zip(symbols, gone) if not out]


class Merger:
    """The same merges for many words side by side: a row a word, each round merges one pair of every row that has one."""

    WIDTHS = (8, 16, 32)  #: words are sorted into rows of these sizes; longer ones are merged one by one
    PAD = (1 << SHIFT) - 1

    def __init__(self, vocabulary: Vocabulary):
        self.encode, self.bytes_ = vocabulary.encode, np.array([*vocabulary.bytes_, self.PAD], np.int64)
        pairs = np.fromiter(vocabulary.merges.keys(), np.int64, len(vocabulary.merges))
        order = np.argsort(pairs)
        self.none = len(pairs) << SHIFT
        self.pairs = np.append(pairs[order], -1)
        self.merged = np.append(np.fromiter(vocabulary.merges.values(), np.int64, len(pairs))[order], self.none)
        self.of_bytes = self.found(self.bytes_[:, None], self.bytes_)

    def found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair, in one number; `none` for those that don't merge."""
        pair = a << SHIFT | b
        place = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[place] == pair, self.merged[place], self.none)

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sizes, parts, least = np.zeros(len(words), np.int64), [], 0
        for width in self.WIDTHS:
            rows = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if len(rows):
                letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width).astype(np.int64)
                letters[np.arange(width) >= lengths[rows, None]] = 256
                parts += self._rounds(rows, letters, sizes)
        for i in np.flatnonzero(lengths > least):
            ids = np.array(self.encode(words[i]), np.int64)
            sizes[i] = len(ids)
            parts.append((np.array([i]), ids))
        flat, begins = np.empty(sizes.sum(), np.int64), np.cumsum(sizes) - sizes
        for rows, ids in parts:
            flat[ragged_places(begins[rows], sizes[rows])] = ids
        return flat, sizes

    def _rounds(self, rows: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of those that are finished, round by round; their sizes are set."""
        symbols, ranks = self.bytes_[letters], self.of_bytes[letters[:, :-1], letters[:, 1:]]
        while len(rows):
            going = (ranks < self.none).any(1)
            done = symbols[~going]
            real = done != self.PAD
            sizes[rows[~going]] = real.sum(1)
            yield rows[~going], done[real]
            rows, symbols, ranks = rows[going], symbols[going], ranks[going]
            if not len(rows):
                break
            each, width = np.arange(len(rows)), ranks.shape[1]
            at = ranks.argmin(1)  # the leftmost of the lowest
            symbols[each, at] = ranks[each, at] & self.PAD
            stay = np.arange(width + 1) != at[:, None] + 1
            symbols, ranks = symbols[stay].reshape(len(rows), width), ranks[np.arange(width) != at[:, None]].reshape(len(rows), width - 1)
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left < width - 1))
                ranks[some, left[some]] = self.found(symbols[some, left[some]], symbols[some, left[some] + 1])


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary at path, a .json file of a byte-level BPE whose pre-tokens are matches of pattern."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ids = {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    merges = {ids[a] << SHIFT | ids[b]: rank << SHIFT | ids[a + b] for (a, b), rank in load_merges(path)[0].items()}
    return Vocabulary([ids[bytes([b])] for b in range(256)], ids, merges, special, pattern)


def compiled(words: list[bytes], ids: list[list[int]]) -> list[np.ndarray]:
    """The transducer of distinct, sorted words: its transitions' keys, targets and outputs, what it starts and ends with, and ids by place.

    A key is the state times 256 plus the byte; keys rise, as states are numbered when they are finished. A state that has
    the same transitions and end as an earlier one is that one, so the automaton is minimal. A transition gives out how many
    words leave its state before it (the end of a word counts as one), so the sum along a word is the word's place.
    """
    known: dict[tuple, int] = {}
    reach: list[int] = []  # words from each finished state on
    ends: list[bool] = []
    keys, targets, outputs = [], [], []
    path: list[list] = [[False, []]]  # unfinished states along the last word: whether a word ends there, transitions
    last = b""

    def finish(depth: int) -> int:
        child = -1
        while len(path) > depth:
            end, edges = path.pop()
            sign = (end, *edges)
            child = known.get(sign, -1)
            if child < 0:
                known[sign] = child = len(reach)
                total = int(end)
                for byte, target in edges:
                    keys.append(child << 8 | byte)
                    targets.append(target)
                    outputs.append(total)
                    total += reach[target]
                reach.append(total)
                ends.append(end)
            if path:
                path[-1][1].append((last[len(path) - 1], child))
        return child

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        finish(shared + 1)
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    root = finish(0)
    starts = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), np.int64)
    return [np.array(a, np.int64) for a in (keys, targets, outputs, ends, [root], starts, flat)]


class Lexicon:
    """A compiled transducer in a file that is mapped into memory."""

    def __init__(self, path: str):
        sizes = np.fromfile(path, np.int64, 7)
        ends = np.cumsum(sizes) + 7
        whole = np.memmap(path, np.int64, "r")
        self.keys, self.targets, self.outputs, self.ends, root, self.starts, self.ids = (whole[e - n : e] for e, n in zip(ends, sizes, strict=True))
        self.root = int(root[0])

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word (binary), -1 where the lexicon lacks it; all words walk on side by side, a byte at a time."""
        if not len(words):
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        sizes, out = np.diff(offsets), np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        going = np.flatnonzero(sizes)
        state, total, at = np.full(len(going), self.root), np.zeros(len(going), np.int64), 0
        while len(going):
            key = state << 8 | data[offsets[going] + at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            going, edge, total = going[found], edge[found], total[found]
            state, total, at = self.targets[edge], total + self.outputs[edge], at + 1
            over = sizes[going] == at
            fits = over & (self.ends[state] == 1)
            out[going[fits]] = total[fits]
            going, state, total = going[~over], state[~over], total[~over]
        return out


@lru_cache(maxsize=2)
def opened(name: str) -> Lexicon:
    """The lexicon that Spark has brought to this machine under that name."""
    return Lexicon(SparkFiles.get(name))


def publish(spark: SparkSession, arrays: list[np.ndarray]) -> str:
    """Write a compiled transducer to the shared folder and let Spark bring it to every executor, later ones too; its name."""
    folder = with_checkpoints(spark).sparkContext.getCheckpointDir()
    name, jvm = f"lexicon-{uuid.uuid4()}", spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for part in (np.array([len(a) for a in arrays]), *arrays):
            out.write(bytearray(part.astype("<i8").tobytes()))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toUri().toString())
    return name


class Words(Numbers):
    """A text's pre-tokens by number; a special string is a word of its own, named by its id."""

    def __init__(self, vocabulary: Vocabulary):
        self.match, self.special = regex.compile(vocabulary.pattern).findall, vocabulary.special
        self.of_piece = PieceNumbers(self, self.match)
        self.at_special = at_special(vocabulary.special)

    def plain(self, text: str) -> Iterator[int]:
        first, *rest = pieces(text)
        return chain(map(self.__getitem__, self.match(first)), chain.from_iterable(map(self.of_piece.__getitem__, rest)))

    def add(self, text: str) -> np.ndarray:
        """The numbers of the text's words."""
        if not any(s in text for s in self.special):
            return np.fromiter(self.plain(text), np.int32)
        parts = self.at_special.split(text)  # texts and special strings in turn
        return np.fromiter(chain.from_iterable((self[self.special[p]],) if i % 2 else self.plain(p) for i, p in enumerate(parts)), np.int32)


class WordIds(Words):
    """Words that keep their numbers from block to block, each with its ids: the lexicon's, or merged on first use."""

    def __init__(self, vocabulary: Vocabulary, known: Lexicon):
        super().__init__(vocabulary)
        self.of_piece.most = 250_000
        self.encode_all, self.known, self.done = Merger(vocabulary).encode_all, known, 0
        self.flat, self.begins, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, and by number each word's start and size in it."""
        words, known = list(islice(self, self.done, None)), self.known
        raw = [b"" if isinstance(w, int) else w.encode() for w in words]
        places = known.places(pa.array(raw, pa.binary()))
        there, special = places >= 0, np.array([i for i, w in enumerate(words) if isinstance(w, int)], np.int64)
        own, own_sizes = self.encode_all([raw[i] for i in np.flatnonzero(~there)])
        sizes = np.empty(len(words), np.int64)
        sizes[there] = known.starts[places[there] + 1] - known.starts[places[there]]
        sizes[~there] = own_sizes
        sizes[special] = 1
        flat = np.empty(sizes.sum(), "<u4")
        begins = np.cumsum(sizes) - sizes
        flat[ragged_places(begins[there], sizes[there])] = known.ids[ragged_places(known.starts[places[there]], sizes[there])]
        flat[ragged_places(begins[~there], own_sizes)] = own
        flat[begins[special]] = [words[i] for i in special]
        self.begins, self.sizes = np.concatenate([self.begins, begins + len(self.flat)]), np.concatenate([self.sizes, sizes])
        self.flat, self.done = np.concatenate([self.flat, flat]), len(self)
        return self.flat, self.begins, self.sizes


def at_special(special: dict[str, int]) -> regex.Pattern:
    return regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")


def word_counts(rows: DataFrame, vocabulary: Vocabulary, block_bytes: int = 1 << 23) -> DataFrame:
    """(word, n): how often each pre-token occurs in column text; a block of texts sends each of its words once."""
    special, pattern = vocabulary.special, vocabulary.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_piece = pretokens_of_piece(pattern)
        first, rest, size = Counter(), Counter(), 0

        def words() -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for lead, seen in (("", first), (" ", rest)):
                for piece, n in seen.items():
                    for word in cut_piece(lead + piece):
                        found[word] += n
                seen.clear()
            names = [w.encode() for w in found]
            for at in range(0, len(names), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 14)], pa.binary()), pa.array(list(found.values())[at : at + (1 << 14)], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for part in at_special(special).split(text)[::2] if any(s in text for s in special) else [text]:
                    head, *tail = pieces(part)
                    first[head] += 1
                    rest.update(tail)
                size += len(text)
                if size >= block_bytes:
                    yield from words()
                    size = 0
        yield from words()

    return rows.select("text").mapInArrow(count, "word binary, n long").where(F.octet_length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(rows: DataFrame, vocabulary: Vocabulary, most: int = 1 << 16) -> list[np.ndarray]:
    """The transducer of the most frequent pre-tokens of column text, counted over all rows, at most `most` of them.

    Counts are taken in steps of a sixteenth of a power of two, and words of one step come in together or not at all: a few hundred
    numbers say where to cut, and only the words above the cut reach the driver.
    """
    counts = saved(word_counts(rows, vocabulary).withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    taken, cut = 0, None
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):
        taken += n
        if taken > most:
            break
        cut = step
    words = sorted(bytes(r.word) for r in counts.where(F.col("step") >= cut).select("word").collect()) if cut is not None else []
    return compiled(words, [vocabulary.encode(w) for w in words])


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", most: int = 1 << 16, block_bytes: int = 1 << 22, most_words: int = 250_000
) -> DataFrame:
    """(key, n_tokens, ids) for every row: ids of the whole text, special strings recognised, as little-endian unsigned 32-bit integers.

    The lexicon holds `most` words; a worker keeps the ids of words that it has met, and begins anew once they are more than
    most_words; a block of texts has block_bytes (a longer text is a block of its own). Null and empty texts have no ids; repeated rows and null keys come
    out as they came in; an empty table gives no rows. The words are counted and the texts encoded in two passes over docs.
    """
    rows = keyed(docs, key, text)
    spark, key_field = docs.sparkSession, rows.schema["key"]
    name = publish(spark, lexicon(rows, vocabulary, most))
    shared = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, keys, size = WordIds(shared.value, opened(name)), [], [], 0

        def shut() -> Iterator[pa.RecordBatch]:
            flat, begins, sizes = words.table()
            at = 0
            for part in keys:
                made = [flat[ragged_places(begins[n], sizes[n])] for n in numbers[at : at + len(part)]]
                at += len(part)
                ids = pa.array([m.tobytes() for m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part, pa.array([len(m) for m in made], pa.int64()), ids], ["key", "n_tokens", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for row in part.column("text").to_pylist():
                    numbers.append(words.add(row))
                    size += len(row)
                keys.append(part.column("key"))
                if size >= block_bytes:
                    yield from shut()
                    words, numbers, keys, size = words if len(words) < most_words else WordIds(shared.value, opened(name)), [], [], 0
        if numbers:
            yield from shut()

    schema = T.StructType([T.StructField("key", key_field.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(encode, schema).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids added, as a string; special ids give their strings, bytes that are no UTF-8 the replacement character.

    Null ids give null; an id outside the vocabulary fails the job. The table of token bytes is as large as the vocabulary.
    """
    by_id = {i: b for b, i in vocabulary.ids.items()} | {i: s.encode() for s, i in vocabulary.special.items()}
    parts = [by_id.get(i) for i in range(max(by_id) + 1)]
    sizes = np.array([-1 if p is None else len(p) for p in parts])
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(p or b"" for p in parts), np.uint8), np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), sizes))
    kept = encoded.schema.fields

    def each(blob: bytes | None) -> str | None:
        if blob is None:
            return None
        data, begins, sizes = shared.value
        tokens, out = np.frombuffer(blob, "<u4"), []
        for at in range(0, len(tokens), 1 << 18):
            some = tokens[at : at + (1 << 18)]
            n = sizes[some]
            if (n < 0).any():
                raise ValueError("an id outside the vocabulary")
            out.append(data[ragged_places(begins[some], n)].tobytes())
        return b"".join(out).decode(errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([each(b) for b in part.column(ids).to_pylist()], pa.string())], [*(f.name for f in kept), into])

    return encoded.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
