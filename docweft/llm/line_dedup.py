"""Line deduplication by a segment-partition edit join, in DataFrame functions throughout.

Two lines within k edits: if the shorter is split into k + 1 segments, one of them is untouched and occurs in the longer
one, shifted by at most k. So each line enters an index of its segments under its length, and probes the indexes of the
lengths from its own down to k less with the few substrings that can align. Pairs that meet are verified by a banded
bit-parallel edit distance. Equal lines are one line beforehand: what is joined are distinct lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import numbered_columns

#: Letters counted to tell lines apart before verification; an edit changes two counts by one at most.
LETTERS = "eanoirst"
#: A null key stands last.
LAST = (1 << 63) - 1


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def distinct_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(line, owner): the distinct lines with a word, and the least key of a document that has each; null keys last."""
    owner = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    rows = docs.select(owner.alias("owner"), F.explode(F.array_distinct(lines_of(F.col(text)))).alias("line"))
    return rows.where(has_word(F.col("line"))).groupBy("line").agg(F.min("owner").alias("owner"))


def segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i of k + 1 in a line of this length; the last ones are longer by one."""
    size, longer = F.floor(length / (k + 1)), F.pmod(length, F.lit(k + 1))
    plain = (k + 1) - longer
    start = 1 + size * i + F.greatest(F.lit(0), F.lit(i) - plain)
    return start.cast("int"), (size + F.when(F.lit(i) >= plain, 1).otherwise(0)).cast("int")


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, each modulo 256, in the bytes of one long."""
    count = lambda c: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
    return reduce(lambda a, c: F.shiftleft(a, 8).bitwiseOR(F.pmod(count(c), F.lit(256)).cast("long")), LETTERS, F.lit(0).cast("long"))


def counts_allow(a: Column, b: Column, k: int) -> Column:
    """Whether two letter counts can come of lines within k edits: at most 2k steps in all, k in each letter."""
    gaps = []
    for i in range(len(LETTERS)):
        d = F.pmod(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)), F.lit(256))
        gaps.append(F.least(d, 256 - d))
    return (reduce(lambda x, y: x + y, gaps) <= 2 * k) & (F.greatest(*gaps) <= k)


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of a to b, exact up to k (more: some number above k), for lengths that differ by at most k.

    Bit-parallel along a diagonal band: bit d of the words stands for row j - k + d of column j, 2k + 1 bits in all.
    p and n mark the steps up and down within a column; z the cells that cost no more than their upper left neighbour.
    The cost is followed along the diagonal that ends in the last cell.
    """
    long_, short = F.split(F.when(F.length(a) >= F.length(b), a).otherwise(b), ""), F.split(F.when(F.length(a) >= F.length(b), b).otherwise(a), "")
    width = 2 * k + 1
    band, lit = (1 << width) - 1, lambda x: F.lit(x).cast("long")
    texts = F.struct(long_.alias("rows"), short.alias("cols"))

    def run(t: Column) -> Column:
        rows, cols = t["rows"], t["cols"]
        gap = F.size(rows) - F.size(cols)

        def step(s: Column, j: Column) -> Column:
            same = lambda d: F.when(F.get(rows, j - 1 - k + d) == F.get(cols, j - 1), lit(1 << d)).otherwise(lit(0))
            x = reduce(lambda u, v: u.bitwiseOR(v), [same(d) for d in range(width)]).bitwiseOR(s["n"])
            z = (x.bitwiseAND(s["p"]) + s["p"]).bitwiseXOR(s["p"]).bitwiseOR(x).bitwiseAND(lit(band))
            up = s["n"].bitwiseOR(F.bitwise_not(z.bitwiseOR(s["p"]))).bitwiseAND(lit(band))
            down, shifted = z.bitwiseAND(s["p"]), F.shiftright(z, 1)
            p = down.bitwiseOR(F.bitwise_not(shifted.bitwiseOR(up))).bitwiseAND(lit(band))
            free = F.shiftright(z, k).bitwiseAND(lit(band))
            cost = s["cost"] + F.when(F.element_at(F.array(*[F.shiftright(free, g).bitwiseAND(lit(1)) for g in range(k + 1)]), gap + 1) == 1, 0).otherwise(1)
            return F.struct(p.alias("p"), shifted.bitwiseAND(up).alias("n"), cost.alias("cost"))

        start = F.struct(lit(band - ((1 << k) - 1)).alias("p"), lit(0).alias("n"), gap.alias("cost"))
        columns = F.when(F.size(cols) > 0, F.sequence(F.lit(1), F.size(cols))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, step, lambda s: s["cost"])

    return F.element_at(F.transform(F.array(texts), run), 1)


def likely(rows: DataFrame, wanted: DataFrame, words: int = 1 << 16) -> DataFrame:
    """The rows whose `id` may be among the wanted ones: those that hit a bitmap of fixed size, 64 bits a word.

    The bitmap has `words` rows at most, whatever the input, so it is broadcast; a join has to follow. It spares the
    shuffle of rows that nothing asks for; when it fills up, it spares less.
    """
    slot = F.pmod(F.col("id"), F.lit(64 * words))
    one_bit = F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")
    bitmap = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one_bit).alias("bits"))
    marked = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bitmap), "word")
    return marked.where(F.col("bits").bitwiseAND(one_bit) != 0).select(*rows.columns)


def near_pairs(lines: DataFrame, k: int = 1, min_chars: int = 24) -> DataFrame:
    """(first, second) for lines within k edits of each other, both structs (owner, line), first < second.

    Lines under min_chars code points have no near ones. A crowded segment makes the join skewed, which adaptive
    execution splits; the letter counts in its condition keep pairs that can't be near from coming out of it.
    """
    # The length comes with the owner, and so does the id: each use of the lines then is one and the same shuffle.
    chars = F.when(F.col("owner").isNotNull(), F.length("line"))
    long_enough = lines.select("line", "owner", chars.alias("chars")).where(F.col("chars") >= max(min_chars, k + 1))
    marked = long_enough.select("line", "chars", F.xxhash64("line", "owner").alias("id"), letter_counts(F.col("line")).alias("letters"))
    entry = lambda length, i, part: F.xxhash64(length, F.lit(i), part)
    entries, probes = [], []
    for i in range(k + 1):
        start, size = segment(F.col("chars"), i, k)
        entries.append(entry(F.col("chars"), i, F.substring(F.col("line"), start, size)))
    for less in range(k + 1):
        length = F.col("chars") - less
        for i in range(k + 1):
            start, size = segment(length, i, k)
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                inside = (start + shift >= 1) & (start + shift + size - 1 <= F.col("chars")) & (length >= max(min_chars, k + 1))
                found = F.when(inside, F.struct(F.lit(less > 0).alias("longer"), entry(length, i, F.substring(F.col("line"), start + shift, size)).alias("at")))
                probes.append(found)
    index = marked.select("id", "letters", F.explode(F.array(*entries)).alias("at"))
    probe = marked.select(F.col("id").alias("id2"), F.col("letters").alias("letters2"), F.explode(F.array_compact(F.array(*probes))).alias("hit"))
    probe = probe.select("id2", "letters2", "hit.longer", F.col("hit.at").alias("at"))
    one_way = (F.col("longer") & (F.col("id") != F.col("id2"))) | (F.col("id") < F.col("id2"))
    pairs = index.join(probe, (index["at"] == probe["at"]) & one_way & counts_allow(F.col("letters"), F.col("letters2"), k))
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    named = long_enough.select(F.xxhash64("line", "owner").alias("id"), F.struct("owner", "line").alias("entry"))
    named = likely(named, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = named.select(F.col("id").alias("a"), F.col("entry").alias("x"))
    right = named.select(F.col("id").alias("b"), F.col("entry").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    close = both.where((F.abs(F.length("x.line") - F.length("y.line")) <= k) & (edit_distance(F.col("x.line"), F.col("y.line"), k) <= k))
    return close.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def judged_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 1, min_chars: int = 24) -> DataFrame:
    """(line, owner, near) for each distinct line with a word: near if an earlier line lies within k edits of it.

    Earlier: of a document with a lesser key, or of the same one and first by code points.
    """
    lines = distinct_lines(docs, key, text)
    near = near_pairs(lines, k, min_chars).select(F.col("second.line").alias("line"), F.lit(True).alias("near")).distinct()
    return lines.join(near, "line", "left").select("line", "owner", F.coalesce("near", F.lit(False)).alias("near"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 1, min_chars: int = 24) -> DataFrame:
    """(key, n_lines, n_kept, n_near, kept_chars) for every row.

    n_lines: lines with a word; n_kept: those that deduplicate() keeps; n_near: distinct ones, first of their kind, that
    go because an earlier line is near; kept_chars: code points of the kept lines.
    """
    judged = judged_lines(docs, key, text, k, min_chars)
    keeps = judged.groupBy("owner").agg(
        F.count_if(~F.col("near")).alias("n_kept"), F.count_if("near").alias("n_near"), F.sum(F.when(~F.col("near"), F.length("line"))).alias("kept_chars")
    )
    rows = docs.select(F.col(key).alias("key"), F.size(F.filter(lines_of(F.col(text)), has_word)).cast("long").alias("n_lines"))
    rows = rows.withColumn("owner", F.coalesce(F.col("key").cast("long"), F.lit(LAST)))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(keeps, "owner", "left").select(F.col("key").alias(key), "n_lines", none("n_kept"), none("n_near"), none("kept_chars"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 1, min_chars: int = 24) -> DataFrame:
    """docs with the lines that repeat an earlier line, or lie within k edits of one, cut from the texts.

    A line stays in the document with the least key that has it, at its first place there. Lines without a word stay
    where they are. key is an integer column; rows that share a key, or have none, count as one document: each keeps
    the lines that it owns. A null text stays null, a text all of whose lines go becomes empty; every row comes out; all
    columns stay; of columns of one name the first counts. An empty table gives no rows. The lines that a key owns are gathered for
    its rows; rows without key, of which there may be any number, meet theirs line by line, a text at a time.
    """
    rows, names = numbered_columns(docs)
    judged = judged_lines(rows, names[key], names[text], k, min_chars).where(~F.col("near"))
    whole, has_key = F.col(names[text]), F.col(names[key]).isNotNull()
    of_key = judged.where(F.col("owner") != LAST).groupBy("owner").agg(F.collect_list("line").alias("kept"))
    own = rows.where(has_key).withColumn("owner", F.col(names[key]).cast("long")).join(of_key, "owner", "left").drop("owner")
    free = rows.where(~has_key).withColumn("print", F.md5(whole.cast("string")))
    lines = free.select("print", F.explode(F.array_distinct(lines_of(whole))).alias("line")).where(has_word(F.col("line"))).distinct()
    of_text = lines.join(judged.where(F.col("owner") == LAST).select("line"), "line", "left_semi").groupBy("print").agg(F.collect_list("line").alias("kept"))
    both = own.unionByName(free.join(of_text, "print", "left").drop("print"))
    blank = lambda x, i: F.when(has_word(x), x).otherwise(F.concat(F.lit("\n"), i.cast("string"), F.lit(":"), x))
    marked = F.transform(lines_of(whole), blank)
    is_blank = lambda x: x.startswith("\n")
    stay = F.array_intersect(marked, F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.filter(marked, is_blank)))
    shown = F.transform(stay, lambda x: F.when(is_blank(x), F.regexp_replace(x, r"^\n\d+:", "")).otherwise(x))
    new = F.when(whole.isNotNull(), F.array_join(shown, "\n"))
    return both.select(*[(new if c == names[text] else F.col(c)).alias(old) for old, c in names])


ORACLE_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
owned AS (SELECT line, min(coalesce(doc_id, 9223372036854775807)) AS owner, length(line) AS chars FROM worded GROUP BY line),
long_enough AS (SELECT * FROM owned WHERE chars >= 24),
pairs AS (
  SELECT a.owner AS owner_a, a.line AS line_a, b.owner AS owner_b, b.line AS line_b, a.chars AS m, b.chars AS n
  FROM long_enough a JOIN long_enough b
    ON b.chars IN (a.chars, a.chars + 1) AND (b.chars > a.chars OR a.line < b.line)
  WHERE left(a.line, a.chars // 2) = left(b.line, a.chars // 2)
     OR right(a.line, a.chars - a.chars // 2 - 1) = right(b.line, a.chars - a.chars // 2 - 1)),
close AS (
  SELECT * FROM pairs WHERE len(list_filter(range(0, m + 1), lambda i:
    left(line_a, i) = left(line_b, i)
    AND right(line_a, m - i - CASE WHEN m = n AND i < m THEN 1 ELSE 0 END) = right(line_b, n - i - CASE WHEN i < n THEN 1 ELSE 0 END))) > 0),
near AS (SELECT DISTINCT CASE WHEN (owner_a, line_a) < (owner_b, line_b) THEN line_b ELSE line_a END AS line FROM close),
judged AS (SELECT o.*, n.line IS NOT NULL AS near FROM owned o LEFT JOIN near n ON o.line = n.line),
keeps AS (
  SELECT owner, count(*) FILTER (NOT near) AS n_kept, count(*) FILTER (near) AS n_near, sum(chars) FILTER (NOT near) AS kept_chars
  FROM judged GROUP BY owner)
SELECT doc_id, (SELECT count(*) FROM unnest(string_split(coalesce(d.text, ''), chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]'))::BIGINT AS n_lines,
  coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(kept_chars, 0)::BIGINT AS kept_chars
FROM documents d LEFT JOIN keeps k ON k.owner = coalesce(d.doc_id, 9223372036854775807)
"""
