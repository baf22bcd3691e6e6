"""Ranked lexical search over a tiered inverted index.

The index keeps, of each term, the postings of high impact in the first tier and the others, by falling impact, in later
tiers, and for each tier the highest impact below it, the residual bound. An item reads the first tier of its terms;
documents whose bound reaches the item's k-th score are scored in full. An item is proved exact once no unread posting
could lift an unseen document to its k-th score. Items without that proof fall through to the next tier, of those terms
alone whose residual bounds stand in the way.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import keyed, saved, small_batches, with_checkpoints

#: All ASCII characters but digits and letters end a term; bytes of other characters never do.
_ENDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
FIRST, GROWTH = 64, 16  #: postings of a term in its first tier, about, and how much more each later one has
STEP = 10  #: postings are dealt to tiers by impact in steps of 2^STEP


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().translate(_ENDS).split()


class Index:
    """The tiered index of some documents for some terms.

    forward: (row, key, n, terms, tfs), a row a document with terms, terms by number and rising; weights: (term, w), the
    documents a term has decide on w; tiers: (term, tier, postings, residual); postings(tier): (term, row, impact).
    """

    def __init__(self, forward: DataFrame, weights: DataFrame, tiers: DataFrame, folder: str):
        self.forward, self.weights, self.tiers, self.folder = forward, weights, tiers, folder

    def postings(self, upto: int) -> DataFrame:
        """(term, row, impact, tier) of the tiers up to one; later tiers' files are not read."""
        return self.forward.sparkSession.read.parquet(self.folder).where(F.col("tier") <= upto)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key, term): the distinct terms of each row of items, a row being an item; saved."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("key"), pa.array(terms, pa.list_(pa.binary()))], ["item", "key", "terms"])

    rows = keyed(items, key, text).withColumn("item", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("item", T.LongType()), rows.schema["key"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return saved(rows.mapInArrow(cut, schema).select("item", "key", F.explode("terms").alias("term")))


def forward_rows(rows: DataFrame, asked: DataFrame, most_bytes: int = 1 << 25) -> DataFrame:
    """(row, key, n, terms, tfs) of each text with terms: n of all terms, the numbers of the `asked` (term, number) ones, rising, and how often each occurs.

    The asked terms go to the workers where they have at most most_bytes; beyond that all terms meet them in a join.
    """
    size = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    numbers = rows.sparkSession.sparkContext.broadcast({bytes(r.term): r.number for r in asked.toLocalIterator()}) if size <= most_bytes else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value if numbers else None
        for batch in batches:
            for part in small_batches(batch, 128):
                sizes, terms, tfs = [], [], []
                for text in part.column("text").to_pylist():
                    words = terms_of(text)
                    sizes.append(len(words))
                    found = Counter(words)
                    pairs = sorted((known[w], found[w]) for w in known.keys() & found.keys()) if known is not None else list(found.items())
                    terms.append([p[0] for p in pairs])
                    tfs.append([p[1] for p in pairs])
                arrays = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32() if known is not None else pa.binary())), pa.array(tfs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), *arrays], ["row", "key", "n", "terms", "tfs"])

    kind = T.IntegerType() if numbers else T.BinaryType()
    schema = T.StructType(
        [T.StructField("row", T.LongType()), rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(kind)), T.StructField("tfs", T.ArrayType(T.LongType()))]
    )
    counted = rows.select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(count, schema).where("n > 0")
    if numbers:
        return saved(counted)
    counted = saved(counted)
    met = counted.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).join(asked, "term")
    lists = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "tf"))).alias("p"))
    empty = F.array().cast("array<struct<number:int,tf:bigint>>")
    joined = counted.select("row", "key", "n").join(lists, "row", "left").withColumn("p", F.coalesce("p", empty))
    return saved(joined.select("row", "key", "n", F.col("p.number").alias("terms"), F.col("p.tf").alias("tfs")))


def build(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = 1 << 25) -> Index:
    """The tiered index of docs for the asked (term, number)s; every document counts for lengths and numbers of documents."""
    forward = forward_rows(keyed(docs, key, text), asked, most_bytes)
    count, length = forward.agg(F.count("*"), F.sum("n")).first()
    each = forward.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    postings = each.select("term", "row", impact(F.col("tf"), F.col("n"), count, length or 1).alias("impact"))

    steps = postings.groupBy("term", F.shiftright("impact", STEP).alias("step")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    higher = Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(higher), F.lit(0))
    rough = F.when(before < FIRST, F.lit(0)).otherwise(1 + F.floor(F.log(float(GROWTH), before / F.lit(FIRST))))
    dealt = steps.withColumn("rough", rough).groupBy("term", "rough").agg(F.min("step").alias("low"), F.sum("n").alias("postings"), F.max("top").alias("top"))
    falling = Window.partitionBy("term").orderBy("rough")
    tiers = saved(
        dealt.select(
            "term", (F.row_number().over(falling) - 1).alias("tier"), "low", "postings", F.coalesce(F.lead("top").over(falling), F.lit(0).cast("long")).alias("residual"),
        )
    )
    frequency = tiers.groupBy("term").agg(F.sum("postings").alias("df"), F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
    weights = saved(frequency.select("term", F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1))).alias("w"), "lows"))
    folder = f"{with_checkpoints(docs.sparkSession).sparkContext.getCheckpointDir()}/postings-{uuid.uuid4()}"
    placed = postings.join(small(weights).where("w > 0").select("term", "lows"), "term")
    tier = F.size(F.filter("lows", lambda low: F.shiftright(F.col("impact"), STEP) < low))
    placed.select("term", "row", "impact", tier.alias("tier")).write.partitionBy("tier").parquet(folder)
    return Index(forward, weights.select("term", "w"), tiers, folder)


def impact(tf: Column, n: Column, count: int, length: int) -> Column:
    """What one occurrence count adds to a score, before the term's weight: (1e9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L."""
    m = F.lit(50).cast("long") + F.call_function("div", n * F.lit(50 * count), F.lit(length).cast("long"))
    return F.call_function("div", tf * F.lit(10**9), tf * F.lit(1000) + m * 20)


def small(rows: DataFrame, at_most: int = 1 << 20) -> DataFrame:
    """rows, saved ones of a few numbers each, marked for a broadcast where they are at_most."""
    return F.broadcast(rows) if rows.count() <= at_most else rows


def full_scores(pairs: DataFrame, index: Index, terms: DataFrame, stats: tuple[int, int]) -> DataFrame:
    """(item, row, key, score) of saved (item, row) pairs: the whole score, from the documents' own lists of terms."""
    lists = saved(terms.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("p")).select("item", F.col("p.term").alias("asked"), F.col("p.w").alias("ws")))
    met = index.forward.join(small(pairs), "row").join(F.broadcast(lists) if terms.count() <= 1 << 20 else lists, "item")
    count, length = stats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, tf = _flat(batch.column("terms"), batch.column("tfs"))
            own, asked, w = _flat(batch.column("asked"), batch.column("ws"))
            n = batch.column("n").to_numpy()
            names, sought = at << 32 | term, own << 32 | asked  # both rise
            place = np.minimum(np.searchsorted(sought, names), max(len(sought) - 1, 0))
            hit = sought[place] == names if len(sought) else np.zeros(len(names), bool)
            at, tf, w = at[hit], tf[hit], w[place[hit]]
            m = 50 + (50 * count * n) // length
            scores = np.zeros(batch.num_rows, np.int64)
            np.add.at(scores, at, w * ((10**9 * tf) // (1000 * tf + 20 * m[at])))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("row"), batch.column("key"), pa.array(scores)], ["item", "row", "key", "score"])

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("row", T.LongType()), index.forward.schema["key"], T.StructField("score", T.LongType())])
    return met.select("item", "row", "key", "n", "terms", "tfs", "asked", "ws").mapInArrow(score, schema)


def _flat(*lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """The place of the list that each value lies in, then the values of each list array."""
    offsets = [x.offsets.to_numpy() for x in lists]
    values = [x.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]].astype(np.int64) for x, o in zip(lists, offsets, strict=True)]
    return np.repeat(np.arange(len(lists[0])), np.diff(offsets[0])), *values


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", most_bytes: int = 1 << 25) -> DataFrame:
    """(item_key, rank, key, score): the k documents of highest score above 0 for each item, ties to the smaller key, null keys last.

    A row of docs is a document and a row of items an item, whatever its key: repeated rows each count and come out. Null
    and empty texts have no terms; a document without terms doesn't count, an item without any gets no rows, nor does any
    item where there are no documents. Rows of equal score and key come in the order of the stored table. docs must be a
    stored table or another input whose rows don't change.
    """
    spark = docs.sparkSession
    own = item_terms(items, item_key, text)
    asked = saved(_numbered(own.select("term").distinct()))
    index = build(docs, asked, key, text, most_bytes)
    stats = index.forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    terms = saved(own.join(asked, "term").select("item", F.col("number").alias("term")).join(index.weights.where("w > 0"), "term").select("item", "term", "w"))
    deepest = index.tiers.agg(F.max("tier")).first()[0]

    best = spark.createDataFrame([], T.StructType([T.StructField("item", T.LongType()), T.StructField("row", T.LongType()), index.forward.schema["key"], T.StructField("score", T.LongType())]))
    reading = terms.withColumn("tier", F.lit(0))  # what is read now
    read = reading  # how far each term of an open item has been read
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    # A term may stay where it is for a round, so there can be more rounds than tiers; from then on no term of an open item stays.
    for round_ in range(2 * deepest + 1 if deepest is not None else 0):
        bounds = _with_residual(read, index)
        limit = saved(bounds.groupBy("item").agg(F.sum(F.col("w") * F.col("residual")).alias("unseen")))
        asks = saved(_with_residual(reading, index))
        found = index.postings(round_).join(small(asks), ["term", "tier"])
        seen = found.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.sum(F.col("w") * (F.col("impact") - F.col("residual"))).alias("over"))
        if round_ == 0:
            seen = saved(seen)
        least = saved(_kth(best if round_ else seen, k))
        held = seen.join(small(limit), "item").join(small(least), "item", "left").where(F.col("over") + F.col("unseen") >= F.coalesce("least", F.lit(0)))
        pairs = saved(held.select("item", "row"))
        scored = full_scores(pairs, index, terms, stats)
        ranked = best.unionByName(scored).dropDuplicates(["item", "row"]).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        best = saved(ranked.drop("rank"))
        proof = F.coalesce("least", F.lit(0).cast("long"))
        open_ = bounds.join(limit.join(_kth(best, k), "item", "left").where((F.col("unseen") > 0) & (F.col("unseen") >= proof)).select("item", proof.alias("least")), "item")
        left = F.sum(F.col("w") * F.col("residual")).over(Window.partitionBy("item").orderBy(F.col("w") * F.col("residual"), "term"))
        moved = open_.withColumn("falls", (F.col("residual") > 0) & ((left >= F.col("least")) | F.lit(round_ >= deepest)))
        read = saved(moved.select("item", "term", "w", (F.col("tier") + F.col("falls").cast("int")).alias("tier"), "falls"))
        reading = read.where("falls").drop("falls")
        read = read.drop("falls")
        if reading.isEmpty():
            break
    ranked = best.withColumn("rank", F.row_number().over(first).cast("int"))
    named = own.select("item", F.col("key").alias("item_key")).distinct()
    return ranked.join(named, "item").where("score > 0").select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


def _numbered(terms: DataFrame) -> DataFrame:
    """(term, number): numbers from 0 without gaps, by sizes of partitions and places within."""
    placed = saved(terms.select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "low", before.alias("before"))
    return placed.join(F.broadcast(starts), "part").select("term", (F.col("id") - F.col("low") + F.col("before")).cast("int").alias("number"))


def _with_residual(read: DataFrame, index: Index) -> DataFrame:
    """read with the residual bound below the tier that each term has been read to."""
    return read.join(index.tiers.select("term", "tier", "residual"), ["term", "tier"])


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th best score of the items that have so many."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("item").agg(F.max("rank").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).drop("n")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS pos, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
known AS (SELECT pos, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM known),
one AS (SELECT pos, doc_id, n, unnest(terms) AS term FROM known),
tfs AS (SELECT pos, doc_id, n, term, count(*)::BIGINT AS tf FROM one GROUP BY ALL),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
i AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
weighted AS (
  SELECT item, item_id, i.term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM i JOIN dfs ON i.term = dfs.term, whole),
scored AS (
  SELECT item, item_id, pos, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighted JOIN tfs USING (term), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, pos) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
