"""Language-model scores from a sharded log-frequency Bloom filter of word pairs, beside the exact add-one unigram score.

Words meet their exact counts in a shuffle of distinct words by block. Pairs of words live in a log-frequency Bloom filter
cut into shards: a block sends each shard the hashes of its distinct pairs in one row, the shard's task adds up their
counts, puts the quantised counts into its filter, and answers each block's pairs by repeated membership probes. A filter
of the whole corpus grows with it and can't be broadcast; shards can't outgrow a task, as their number follows the input,
and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.blocks import Block, Numbers, Replies, copies, cut, open_block, shut_block
from docweft.llm.common import lower_words_of, saved
from docweft.llm.lm_filter import BITS_A_MEMBER, Filter, count_of, level_of, mix
from docweft.plans.session import with_small_batches

END = b""  #: the token that ends a text, and stands before its first word
UNIT = np.dtype("<i8")
FIELDS = ["block", "at", "shard", "kind", "reply", "body"]
HASH_BYTES = 7
RESIDUES = -1  #: the shard number of the row that has a block's word residues


class Words(Numbers):
    """A text's words and its end."""

    def add(self, text: str) -> np.ndarray:
        got = lower_words_of(text)
        got.append(END)
        return np.fromiter(map(self.__getitem__, got), np.int32, len(got))


def word_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(3) + mix(second))


def words_before(block: Block, end: int) -> np.ndarray:
    """The number of the word before each token; end before a text's first."""
    before = np.empty_like(block.numbers)
    before[1:] = block.numbers[:-1]
    before[np.cumsum(block.counts) - block.counts] = end
    return before


def pair_codes(block: Block, end: int) -> np.ndarray:
    """The pair that ends in each token, as first * n_words + second."""
    return words_before(block, end).astype(np.int64) * block.n_words + block.numbers


def by_shard(codes: np.ndarray, residues: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each pair, and the pairs' places in order of their shards."""
    first, second = codes // len(residues), codes % len(residues)
    shard = (residues[first].astype(np.int64) * 3 + residues[second]) % shards
    return shard, np.argsort(shard, kind="stable")


def packed(values: np.ndarray) -> bytes:
    return np.array([len(values)], UNIT).tobytes() + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: pa.Buffer, unit: np.dtype) -> np.ndarray:
    """An array sent as its length and its compressed values."""
    n = int(np.frombuffer(blob, UNIT, 1)[0])
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * unit.itemsize, codec="zstd"), unit)


def shut_ask(hashes: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs of one shard as 7 bytes of each hash, enough to tell a shard's few million apart, and their numbers."""
    short = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    return np.array([len(hashes)], UNIT).tobytes() + short.tobytes() + packed(times)


def opened_ask(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, UNIT, 1)[0])
    full = np.zeros((n, 8), np.uint8)
    full[:, :HASH_BYTES] = np.frombuffer(blob, np.uint8, n * HASH_BYTES, 8).reshape(n, HASH_BYTES)
    return full.view("<u8").ravel(), unpacked(blob[8 + n * HASH_BYTES :], np.dtype("<u4"))


def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.array([np.frombuffer(b, UNIT) for b in batch.column("reply").to_pylist()], np.int64).reshape(-1, 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(sums[:1]), pa.array(sums[1:])], ["n", "v"])


def shard_probe(bits_a_member: int):
    """A function of a shard's rows: the blocks' pairs, each replaced by its level in the shard's filter; other rows as they are."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ask = table.filter(pc.equal(table.column("kind"), 1))
        rest = table.filter(pc.equal(table.column("kind"), 0)).select(["block", "shard", "reply", "body"])
        if not ask.num_rows:
            return rest
        asks = [opened_ask(b.as_buffer()) for b in ask.column("reply")]
        keys, times = np.concatenate([a[0] for a in asks]), np.concatenate([a[1] for a in asks])
        seen = times > 0
        learned, place = np.unique(keys[seen], return_inverse=True)
        counts = np.bincount(place, times[seen], len(learned)).astype(np.int64)
        grams = Filter(learned, level_of(counts), bits_a_member)
        del keys, times, seen, learned, place, counts
        replies = [packed(grams.levels(a[0])) for a in asks]
        done = pa.table({"block": ask.column("block"), "shard": ask.column("shard"), "reply": pa.array(replies, pa.binary()), "body": pa.nulls(len(replies), pa.binary())})
        return pa.concat_tables([rest, done])

    return run


def token_scores(tokens: int, types: int, m: float, counts: np.ndarray, before: np.ndarray, numbers: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P(w after h) for tokens w after words h: (c(hw) + m P(w)) / (c(h) + m) with P(w) = (c(w) + 1) / (N + V + 1).

    counts: exact, by word number; pairs: c(hw) of each token as the filter has it, held to what c(h) and c(w) allow, so a
    false positive never makes a pair of an unknown word. With exact pairs all known words and one unknown word sum up to
    1 for every h, as each training occurrence of h is followed by one word or the end; quantised ones, whose middles are
    taken, come near it.
    """
    single = (counts + 1) / (tokens + types + 1.0)
    pairs = np.minimum(pairs, np.minimum(counts[before], counts[numbers]))
    return np.log10((pairs + m * single[numbers]) / (counts[before] + m))


def score(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = 1 << 24,
    m: float = 200.0, shard_bytes: int = 1 << 23, bits_a_member: int = BITS_A_MEMBER,
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row; train, over docs, marks what is learned from.

    base_score: sum of log10((c + 1) / (N + V + 1)) with exact counts. score: the model's log10 probability, see
    token_scores(). Every pair of words of the training texts is in a filter, whatever its words' frequency and the
    input's size; a shard's pairs are told apart by 56-bit hashes. There is a shard for each shard_bytes of text, so a
    filter has at most as many members as that has pairs, times their levels. A null or empty text is its end
    alone. Repeated rows and null keys come out as they came in; an empty table gives no rows; without training texts all
    words are unseen. docs must be a stored table: it is read thrice.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    key_type = rows.schema["key"].dataType
    with_small_batches(docs.sparkSession)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches, Words, block_bytes, ("train",)):
            learned = np.bincount(block.numbers[np.repeat(block.extra["train"], block.counts)], minlength=block.n_words)
            yield from block.word_rows(learned=learned)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block, and rows with no block: tokens and number of distinct words, each word once in the corpus."""
        replies, last = Replies(), None
        for batch in batches:
            counts = batch.column("count").to_numpy()
            values = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.arange(0, 8 * len(counts) + 8, 8, dtype=np.int32)), pa.py_buffer(counts.astype(UNIT))])
            yield from replies.add(batch.column("block"), batch.column("number"), values)
            names = batch.column("word").to_pylist()
            fresh = counts[[i for i, w in enumerate(names) if counts[i] and w != (names[i - 1] if i else last)]]
            last = names[-1] if names else last
            if len(fresh):
                sums = np.array([fresh.sum(), len(fresh)], UNIT).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sums], pa.binary()), pa.nulls(1, pa.binary())], ["block", "reply", "body"])
        yield from replies.rest()

    met = rows.mapInArrow(words, "block long, number int, word binary, learned long")
    counted = met.withColumn("count", F.sum("learned").over(Window.partitionBy("word"))).select("block", "number", "word", "count")
    answers = saved(counted.mapInArrow(reply, "block long, reply binary, body binary"))

    sums = np.zeros(2, np.int64)
    for r in answers.where("block IS NULL").select("reply").mapInArrow(total, "n long, v long").agg(F.sum("n"), F.sum("v")).collect():
        sums += np.array([x or 0 for x in r], np.int64)
    tokens, types = map(int, sums)
    shards = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    residue = np.dtype("<u2" if shards <= 1 << 12 else "<u4")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, shard, kind, reply, body): for each block its body, its word residues, and its pairs by shard (kind 1)."""
        for block in cut(batches, Words, block_bytes, ("train",)):
            keys = word_keys(block.words)
            residues = (keys >> np.uint64(32)).astype(residue)
            codes = pair_codes(block, block.words.index(END))
            trained, times = np.unique(codes[np.repeat(block.extra["train"], block.counts)], return_counts=True)
            codes = np.unique(codes)
            learned = np.zeros(len(codes), "<u4")
            learned[np.searchsorted(codes, trained)] = times
            del trained, times
            shard, order = by_shard(codes, residues, shards)
            codes, learned, shard = codes[order], learned[order], shard[order]
            del order
            edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            name = block.name
            body, n_words = shut_block(block).column("body"), block.n_words
            del block
            for number, blob, rest in ((None, None, body), (RESIDUES, packed(residues), pa.nulls(1, pa.binary()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int64()), pa.array([name], pa.int64()), pa.array([number], pa.int64()), pa.array([0], pa.int32()), pa.array([blob], pa.binary()), rest], FIELDS
                )
            for at in range(0, len(edges) - 1, 16):
                some = list(zip(edges[at : at + 16], edges[at + 1 : at + 17]))
                blobs = [shut_ask(pair_keys(keys[codes[i:j] // n_words], keys[codes[i:j] % n_words]), learned[i:j]) for i, j in some]
                numbers = pa.array(shard[[i for i, _ in some]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), name)), numbers, numbers, pa.array(np.ones(len(some), np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(some), pa.binary())], FIELDS
                )

    asked = rows.mapInArrow(ask, "block long, at long, shard long, kind int, reply binary, body binary")
    counted = asked.groupBy("at").applyInArrow(shard_probe(bits_a_member), "block long, shard long, reply binary, body binary")
    base = float(tokens + types + 1)

    def assemble(table: pa.Table) -> pa.Table:
        of_words = table.filter(table.column("shard").is_null())
        block = open_block(of_words)
        flat, begins, sizes = block.ragged(of_words, UNIT)
        counts = flat[begins] if len(sizes) else np.zeros(0, np.int64)
        blobs = {n: b.as_buffer() for n, b in zip(table.column("shard").to_pylist(), table.column("reply")) if n is not None}
        residues = unpacked(blobs.pop(RESIDUES), residue)
        end = int(block.numbers[block.counts[0] - 1])
        codes, place = np.unique(pair_codes(block, end), return_inverse=True)
        _, order = by_shard(codes, residues, shards)
        pairs = np.empty(len(codes))
        pairs[order] = count_of(np.concatenate([unpacked(blobs[n], np.dtype("u1")) for n in sorted(blobs)]))
        of_token, starts = counts[block.numbers], np.cumsum(block.counts) - block.counts
        scores = token_scores(tokens, types, m, counts, words_before(block, end), block.numbers, pairs[place])
        out = pa.table({
            "key": block.keys, "n_tokens": block.counts, "n_known": np.add.reduceat((of_token > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(np.log10((of_token + 1) / base), starts), "score": np.add.reduceat(scores, starts),
        })
        return pa.concat_tables([out] * copies(table))

    schema = T.StructType([T.StructField("key", key_type), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    of_words = answers.where("block IS NOT NULL").select("block", F.lit(None).cast("long").alias("shard"), "reply", "body")
    out = of_words.unionByName(counted).groupBy("block").applyInArrow(assemble, schema)
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
