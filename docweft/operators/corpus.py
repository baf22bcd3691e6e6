"""What a corpus declares about itself, whether a run covers it, and when two HTML texts say the same."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import SPACE

#: Fixed value: a line that opens a block of an example and what becomes of it.
OPENS = re.compile(r":{3,}\s+compare(\s+\S.*)?")
#: A tag with attributes, and an attribute.
TAG = rf'<([A-Za-z0-9_]+)((?:[{SPACE}]+[A-Za-z0-9_:-]+(?:="[^"]*")?)+)[{SPACE}]*(/?)>'
ATTRIBUTE = r'[A-Za-z0-9_:-]+(?:="[^"]*")?'
MARK = "\u0001"


def line_function(lines: list[str]) -> dict[int, tuple[int, int]]:
    """What a range of lines does to each state: state to (state after it, blocks opened in it).

    State 0 is outside a block, n inside one that n colons opened; a line of just as many closes it. A state that isn't
    among the keys stays, as nothing in the range closes it.
    """
    n, first_of = len(lines), {}
    after: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # by line: what the rest does to state 0
    for i in range(n - 1, -1, -1):
        line = lines[i].strip()
        if OPENS.fullmatch(line):
            colons = len(line) - len(line.lstrip(":"))
            end, count = after[first_of[colons] + 1] if colons in first_of else (colons, 0)
            after[i] = end, count + 1
        else:
            after[i] = after[i + 1]
        if len(line) >= 3 and not line.strip(":"):
            first_of[len(line)] = i
    return {0: after[0], **{colons: after[i + 1] for colons, i in first_of.items()}}


def declared_blocks(lines: DataFrame, doc: str, at: str, line: str, size: int = 1000) -> DataFrame:
    """(doc, declared): how many example blocks the lines of each document open; a line within an open block opens none.

    lines: (doc, at, line), at numbering a document's lines from 0 without gaps. They are cut in ranges of `size`; each becomes the function
    that it is on the reader's state, and a document's functions are composed in order, so no task holds a document's lines. Null lines are empty.
    """
    key = lines.schema[doc]
    ranged = lines.select(F.col(doc).alias("doc"), F.floor(F.col(at) / size).alias("part"), F.col(at).cast("long").alias("at"), F.coalesce(line, F.lit("")).alias("line"))
    texts = ranged.groupBy("doc", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int64(), pa.struct([("ends", pa.int64()), ("count", pa.int64())]))
        for batch in batches:
            made = [[(s, {"ends": e, "count": c}) for s, (e, c) in line_function(x).items()] for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(made, kind)], ["doc", "part", "does"])

    functions = texts.mapInArrow(work, f"doc {key.dataType.simpleString()}, part long, does map<bigint,struct<ends:bigint,count:bigint>>")
    in_order = functions.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.map_entries("does").alias("does")))), lambda x: F.map_from_entries(x["does"])).alias("all"))

    def then(state: Column, does: Column) -> Column:
        hit = F.try_element_at(does, state["ends"])
        return F.struct(F.coalesce(hit["ends"], state["ends"]).alias("ends"), (state["count"] + F.coalesce(hit["count"], F.lit(0))).alias("count"))

    start = F.struct(F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("count"))
    return in_order.select(F.col("doc").alias(doc), F.aggregate("all", start, then, lambda s: s["count"]).alias("declared"))


def shortfalls(counted: DataFrame, label: str, actual: str, least: str) -> DataFrame:
    """(label, finding) of the rows that have fewer than they should; a count that is null or below 0 is a finding too."""
    a, n = F.col(actual), F.col(least)
    said = F.when(a.isNull() | (a < 0), F.concat(F.col(label), F.lit(": no count at all"))).when(a < n, F.concat(F.col(label), F.lit(": "), a.cast("string"), F.lit(" of "), n.cast("string")))
    return counted.select(F.col(label), said.alias("finding")).where("finding IS NOT NULL")


def normal_html(html: Column) -> Column:
    """HTML with the attributes of each tag in order and every run of white space one space, none at either end.

    Tags are set apart by marks, so a tag's attributes are sorted where it stands, whatever their values hold.
    """
    clean = F.replace(html, F.lit(MARK), F.lit(""))
    parts = F.split(F.regexp_replace(clean, f"({TAG})", f"{MARK}$1{MARK}"), MARK)

    def sorted_(tag: Column) -> Column:
        attributes = F.array_join(F.array_sort(F.regexp_extract_all(F.regexp_extract(tag, TAG, 2), F.lit(ATTRIBUTE), F.lit(0))), " ")
        return F.concat(F.lit("<"), F.regexp_extract(tag, TAG, 1), F.lit(" "), attributes, F.regexp_extract(tag, TAG, 3), F.lit(">"))

    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, sorted_(p)).otherwise(p)), "")
    return F.regexp_replace(F.regexp_replace(whole, f"[{SPACE}]+", " "), "^ | $", "")
