"""SimHash near-duplicates by an inverted index over positional bytes, with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. The index has compound postings: the bytes at a set of positions, the sets chosen so that any 5
positions contain one. Pairs that meet in a posting tally their shared positional bytes; those with 5 or more are
verified by their differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import keyed, lower_words_of, numbered_columns, saved, text_pass
from docweft.llm.components import connected_components

BYTES = 8


def fingerprint_batch(texts: list[str], width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half of the shingles' hashes; no words: zero."""
    digest, marks, out = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.uint64)
    hashes: list[int] = []

    def flush() -> None:
        if not marks:
            return
        rows, starts = [m[0] for m in marks], np.array([m[1] for m in marks])
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(hashes)))
        packed = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little")
        out[rows] = packed.view(np.uint64).ravel()
        marks.clear()
        hashes.clear()

    for row, text in enumerate(texts):
        words = lower_words_of(text)
        if not words:
            continue
        marks.append((row, len(hashes)))
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), seed))
        else:
            hashes += [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)]
        if len(hashes) > 30_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed 64-bit integer. A null or empty text has 0."""
    return text_pass(
        keyed(docs, key, text),
        [T.StructField("fp", T.LongType())],
        _column(width, seed),
    )


def _column(width: int, seed: int):
    return lambda texts: [pa.array(fingerprint_batch(texts, width, seed).view(np.int64))]


def covering_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `shared` positions contain one, chosen greedily."""
    open_ = {frozenset(c) for c in combinations(range(BYTES), shared)}
    chosen = []
    while open_:
        best = max(combinations(range(BYTES), size), key=lambda c: sum(o.issuperset(c) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not o.issuperset(best)}
    return chosen


def linked_within(fps: np.ndarray, bits: int, at_least: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one posting: tally shared bytes, then verify bits.

    Links go into the forest a few rows of pairs at a time, and links within a tree are forgotten at once: a crowd whose
    members are all linked holds no more than those rows.
    """
    values = fps.view(np.uint64)
    label = np.arange(len(values))
    for at in range(0, len(values), rows):
        xor = values[at : at + rows, None] ^ values[None, at:]
        tally = (xor.view(np.uint8).reshape(*xor.shape, BYTES) == 0).sum(-1, dtype=np.int8)
        i, j = np.nonzero((tally >= at_least) & (np.bitwise_count(xor) <= bits))
        a, b = label[i + at], label[j + at]
        parent = np.arange(len(values))
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            a, b = parent[a], parent[b]
        label = parent[label]
    member = np.flatnonzero(label != np.arange(len(values)))
    return fps[member], fps[label[member]]


def links(fps: DataFrame, bits: int = 3, posting_bytes: int = 4, block: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that connect all that differ in at most `bits` bits.

    Every pair within `bits` meets in some posting; of a posting's links a spanning forest is kept, so a crowd of
    fingerprints close to each other yields a row a member, and no path is lost. A posting with over `block` members is
    cut into slices, and each pair of slices is a group of its own: groups stay bounded and no pair is skipped.
    """
    at_least = BYTES - bits
    sets = covering_sets(at_least, posting_bytes)
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    def posting(number: int, positions: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for i in positions:
            value = value * 256 + byte(i)
        return value

    postings = fps.select("fp", F.explode(F.array(*[posting(n, s) for n, s in enumerate(sets)])).alias("posting"))
    crowded = postings.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / block)
    sliced = (
        postings.join(crowded, "posting")
        .select("posting", "fp", F.pmod(F.xxhash64("fp"), slices).alias("own"), slices.alias("slices"))
        .select("posting", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other"))
    )
    groups = (
        sliced.groupBy("posting", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def run(batches):
        for batch in batches:
            us, vs = [], []
            lists = batch.column("members")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                u, v = linked_within(values[a:b], bits, at_least)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bits: int = 3
) -> DataFrame:
    """(key, fp, component_id) for every row of docs: component_id is the smallest key reachable over links.

    Equal fingerprints are one node, so a group of any number of copies costs one. Null or empty texts share the
    fingerprint 0 and link like any other; null keys get a component but never name one (all null: null). Repeated rows
    come out as often as they came in; an empty table gives no rows.
    """
    rows = saved(fingerprints(docs, key, text, width, seed))
    return _grouped(rows, bits).select(F.col("key").alias(key), "fp", "component_id")


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """rows (key, fp, and more), which are saved, with root and component_id; root, the group's least fingerprint, tells groups apart."""
    nodes = rows.groupBy("fp").agg(F.min("key").alias("first"))
    roots = saved(connected_components(links(nodes.select("fp"), bits)))
    classed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(classed.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group: that with the smallest key, of rows that share it that whose text's hash is least.

    All columns stay, whatever their names and types. Rows with a null key stay only where their whole group has no key,
    one for the group. Of rows equal in key and text the one whose other columns are least stays; columns that have no
    order, such as maps, don't count, and of rows that differ in those alone any may stay. Null and empty texts are one
    text; an empty table gives no rows.
    """
    marked = keyed(docs, key, text).withColumn("hash", F.xxhash64("text"))
    printed = text_pass(marked, [T.StructField("fp", T.LongType())], _column(width, seed))
    first = _grouped(saved(printed), bits).groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "hash")).alias("m"))
    key_text = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    stays = first.select(key_text(F.col("m.key")).alias("k"), F.col("m.hash").alias("hash"))
    rows, names = numbered_columns(docs)
    hashed = F.xxhash64(F.coalesce(F.col(names[text]).cast("string"), F.lit("")))
    kept = rows.withColumns({"k": key_text(F.col(names[key])), "hash": hashed}).join(stays, ["k", "hash"], "left_semi")
    ordered = [f.name for f in rows.schema.fields if f.name not in (names[key], names[text]) and has_order(f.dataType)]
    whole = F.struct(*[new for _, new in names])
    one = kept.groupBy("k", "hash").agg(F.min_by(whole, F.struct(F.lit(0), *ordered)).alias("row"))
    return one.select(*[F.col(f"row.{new}").alias(old) for old, new in names])


def has_order(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    return has_order(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))
