"""Tables as cells: (table, r, c, ...), rows and columns from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweft.operators.runs import number_runs


def row_lengths(rows: DataFrame, cells: DataFrame, table: str, row: str) -> DataFrame:
    """(table, row, n): cells of every row, 0 for rows without any."""
    counted = cells.groupBy(row).agg(F.count("*").alias("n"))
    return rows.select(table, row).join(counted, row, "left").select(table, row, F.coalesce("n", F.lit(0)).alias("n"))


def widths(lengths: DataFrame, table: str) -> DataFrame:
    """(table, width, n_rows, short_rows): the longest row, and how many are shorter."""
    collected = lengths.groupBy(table, "n").agg(F.count("*").alias("k")).groupBy(table)
    out = collected.agg(F.max("n").alias("width"), F.sum("k").alias("n_rows"), F.max_by("k", "n").alias("_full"))
    return out.select(table, "width", "n_rows", (F.col("n_rows") - F.col("_full")).alias("short_rows"))


def leading_headers(cells: DataFrame, row: str, header: Column) -> DataFrame:
    """(row, lead): header cells before the first other one; cells have c from 0."""
    grouped = cells.groupBy(row).agg(F.min(F.when(~header, F.col("c"))).alias("stop"), F.count("*").alias("n"))
    return grouped.select(row, F.coalesce("stop", "n").cast("long").alias("lead"))


def head_rows(rows: DataFrame, table: str, all_headers: Column) -> DataFrame:
    """(table, head_rows): leading rows made of headers alone; rows have r from 0."""
    grouped = rows.groupBy(table).agg(F.min(F.when(~all_headers, F.col("r"))).alias("stop"), F.count("*").alias("n"))
    return grouped.select(table, F.coalesce("stop", "n").cast("long").alias("head_rows"))


def body_runs(rows: DataFrame, table: str, lead: Column) -> DataFrame:
    """(table, run, lead, n_rows, first_row): consecutive rows with as many leading headers are one body."""
    runs = number_runs(rows.withColumn("_lead", lead), [table], ["r"], F.col("_lead"))
    return runs.groupBy(table, "run").agg(F.min("_lead").alias("lead"), F.count("*").alias("n_rows"), F.min("r").alias("first_row"))


def partition_fits(head: Column, bodies: Column, foot: Column, n_rows: Column) -> Column:
    """Whether the counts of a row grouping are counts and add up to the table's rows; bodies: array<struct<head, body>>."""
    count = lambda x: x.isNotNull() & (x >= 0)
    fine = count(head) & count(foot) & F.forall(bodies, lambda b: count(b["head"]) & count(b["body"]))
    total = head + foot + F.aggregate(bodies, F.lit(0).cast("long"), lambda s, b: s + b["head"] + b["body"])
    return F.coalesce(fine & (total == n_rows), F.lit(False))


def by_table(cells: DataFrame, table: str, schema: str, rows_of: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """What rows_of() makes of the cells of each table, in order of row and column, with the table's key before it.

    One shuffle by table and one sort; a task goes through its sorted cells and holds those of one table at a time.
    """
    kind = cells.schema[table].dataType
    fields = T.StructType([T.StructField(table, kind), *T.StructType.fromDDL(schema).fields])
    names = cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, key_type, types = [], [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                columns = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [f.name for f in fields])
                done.clear()

        for batch in batches:
            if types is None:
                key_type = batch.schema.field(table).type
                types = [key_type, *(to_arrow_type(f.dataType) for f in fields[1:])]
            for row in batch.to_pylist():
                if held and held[0][table] != row[table]:
                    done.extend((held[0][table], *x) for x in rows_of(held))
                    held = []
                    if len(done) > 50_000:
                        yield from flush()
                held.append(row)
        if held:
            done.extend((held[0][table], *x) for x in rows_of(held))
        yield from flush()

    return cells.repartition(table).sortWithinPartitions(table, "r", "c").select(*names).mapInArrow(run, fields)


def origins(cells: list[dict]) -> list[tuple]:
    """(r, c, row_span, col_span) of one table's cells that stay, see invert_spans()."""
    spans: dict[tuple[int, int], list[int]] = {}
    above, line, at = {}, {}, None
    for cell in cells:
        r, c = cell["r"], cell["c"]
        if r != at:
            above, line, at = line if at == r - 1 else {}, {}, r
        own = (r, c)
        if cell["span"] == "col" and c > 0 and c - 1 in line:
            own = line[c - 1][0]
        elif cell["span"] == "row" and c in above and above[c][1] == cell["section"]:
            own = above[c][0]
        line[c] = own, cell["section"]
        span = spans.setdefault(own, [1, 1])
        if own != (r, c) and cell["span"] == "row":
            span[0] = max(span[0], r - own[0] + 1)
        elif own != (r, c) and r == own[0]:
            span[1] = max(span[1], c - own[1] + 1)
    return [(*place, *span) for place, span in spans.items()]


def invert_spans(cells: DataFrame, table: str, span: Column, section: str) -> DataFrame:
    """(table, r, c, row_span, col_span) of the cells that remain when continuation cells are folded into their origins.

    span is `col` for a cell that continues its left neighbour, `row` for one that continues the cell above, null for a
    plain one. A continuation without neighbour, or with one above in another section, stands for itself.
    """
    marked = cells.select(table, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(section).cast("int").alias("section"), span.alias("span"))
    return by_table(marked, table, "r int, c int, row_span int, col_span int", origins)


def covered(cells: list[dict]) -> list[tuple]:
    """(r, c, of_r, of_c, span) of the places of one table that its cells reach, see expand_spans()."""
    width, out, taken = cells[0]["width"], [], {}
    rows: dict[int, list[dict]] = {}
    for cell in cells:
        rows.setdefault(cell["r"], []).append(cell)
    for r in range(cells[0]["n_rows"]):
        todo, c = iter(rows.get(r, ())), 0
        while c < width:
            if (r, c) in taken:
                out.append((r, c, *taken.pop((r, c)), "rowspan"))
                c += 1
                continue
            cell = next((x for x in todo if x["row_span"] is not None), None)
            if cell is None:
                out.append((r, c, None, None, None))
                c += 1
                continue
            own, reach = (cell["r"], cell["c"]), min(max(cell["col_span"], 1), width - c)
            out.append((r, c, *own, None))
            out.extend((r, c + i, *own, "colspan") for i in range(1, reach))
            taken.update({(r + k, c + i): own for k in range(1, min(cell["row_span"], cells[0]["n_rows"] - r)) for i in range(reach)})
            c += max(cell["col_span"], 1)
    return out


def expand_spans(cells: DataFrame, table: str) -> DataFrame:
    """(table, r, c, of_r, of_c, span): every place of a table's grid, with the cell that fills or reaches it.

    cells: (table, r, c, row_span, col_span, width, n_rows), c counting the cells of a row; a row of null spans stands for a
    table without cells. A place that no cell fills has null of_r; span says how a place is reached, null by a cell itself.
    """
    return by_table(cells.select(table, "r", "c", "row_span", "col_span", "width", "n_rows"), table, "r int, c int, of_r int, of_c int, span string", covered)


def run_spans(rows: DataFrame, table: list[str], order: list[str], value: str) -> DataFrame:
    """(value, first order column, row_span) of the runs of equal values down a column."""
    runs = number_runs(rows, table, order, F.col(value))
    return runs.groupBy(*table, "run").agg(F.min(value).alias(value), F.min(order[0]).alias("first_row"), F.count("*").alias("row_span"))


def column_alignment(cells: DataFrame, table: str, stated: Column, header: Column, align: Column) -> DataFrame:
    """(table, c, align): a column's stated alignment, else its first row's if that row is all headers, else default."""
    first = cells.where("r = 0").withColumn("_all", F.min(header).over(Window.partitionBy(table)))
    return first.select(table, "c", F.coalesce(stated, F.when(F.col("_all"), align), F.lit("default")).alias("align"))
