"""References and what they resolve to: first-wins dictionaries, ranked lookups, and what is left unresolved."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import slugify


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate, so copies of a key combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return one.select(*key, *[F.col("row")[c].alias(c) for c in rest])


def heading_targets(headings: DataFrame, document: list[str], order: list[str], text: str, id: str | None = None) -> DataFrame:
    """(document, id, order columns, text): each identifier's first heading; a heading's own id, else its slug."""
    own = F.coalesce(F.nullif(F.col(id), F.lit("")), slugify(F.col(text))) if id else slugify(F.col(text))
    return first_of_each(headings.select(*document, own.alias("id"), *order, text).where("id <> ''"), [*document, "id"], order)


def resolve(refs: DataFrame, targets: DataFrame, target: str, id: str, document: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """refs with the matching target's columns, null where none is.

    A target matches by its exact id; else by the id that is the reference in lower case; else of those that are equal
    without regard to case the first in order (by default, by id). Target ids are unique within a document.
    """
    document, row = document or [], F.struct(*targets.columns)
    by_id = targets.select(*document, F.col(id).alias("_id"), row.alias("_row"))
    folded = targets.groupBy(*document, F.lower(id).alias("_id")).agg(F.min_by(row, F.struct(*(order or [id]))).alias("_row"))
    joined = refs
    for i, (table, wanted) in enumerate(((by_id, F.col(target)), (by_id, F.lower(target)), (folded, F.lower(target)))):
        side = table.select(*[F.col(d).alias(f"_d{i}_{d}") for d in document], F.col("_id").alias(f"_id{i}"), F.col("_row").alias(f"_row{i}"))
        joined = joined.join(side, _all([wanted == F.col(f"_id{i}"), *(F.col(d) == F.col(f"_d{i}_{d}") for d in document)]), "left")
    found = F.coalesce("_row0", "_row1", "_row2")
    return joined.select(*refs.columns, *[found[c].alias(c) for c in targets.columns if c not in document])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def unresolved(refs: DataFrame, targets: DataFrame, target: str, id: str) -> DataFrame:
    """The refs that resolve() finds nothing for."""
    folded = targets.select(F.lower(id).alias("_fold")).distinct()
    return refs.join(folded, F.lower(target) == F.col("_fold"), "left_anti")


def look_up(rows: DataFrame, name: str, table: dict[str, str] | DataFrame, into: str = "value") -> DataFrame:
    """rows with the table's value for a name, null for others.

    A dict is a parameter, held in the plan as a literal; a table of any size is a DataFrame (name, value) of distinct names,
    which is joined.
    """
    if isinstance(table, DataFrame):
        return rows.join(table.select(F.col("name").alias("_key"), F.col("value").alias(into)), F.col(name) == F.col("_key"), "left").drop("_key")
    if not table:
        return rows.withColumn(into, F.lit(None).cast("string"))
    return rows.withColumn(into, F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), F.col(name)))


def ledger(found: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Losses not in the ledger, and entries of the ledger that no longer are losses."""
    return found.join(known, key, "left_anti"), known.join(found, key, "left_anti")


def circles(steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The steps (a, b) of one document from whose b steps lead back to a: both lie in one strongly connected part."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in steps:
        out[a].append(b)
        back[b].append(a)
    done, seen = [], set()
    for top in list(out):
        stack = [] if top in seen else [(top, iter(out[top]))]
        seen.add(top)
        while stack:
            new = next((b for b in stack[-1][1] if b not in seen), None)
            if new is None:
                done.append(stack.pop()[0])
            else:
                seen.add(new)
                stack.append((new, iter(out.get(new, ()))))
    part: dict[int, int] = {}
    for top in reversed(done):
        todo = [] if top in part else [top]
        while todo:
            part.setdefault(at := todo.pop(), top)
            for a in back.get(at, ()):
                if a not in part:
                    part[a] = top
                    todo.append(a)
    return [(a, b) for a, b in steps if part[a] == part[b]]
