"""Column functions and operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docweft.functions import attributes, text
from docweft.operators import diagnostics, quotes, resolve, tables

RNG = random.Random(3)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Hello,  World! ", "Hello-World"), ("Größe 2_a-b", "Größe-2_a-b"), (" x y ", "x-y"), ("§§", ""), ("", "")],
)
def test_slugs(spark, raw, want):
    assert one(spark, text.slugify(F.col("s")), s=raw) == want


def test_panel_letters(spark):
    def letter(k):
        out, i = "", k + 1
        while i:
            i, digit = divmod(i - 1, 26)
            out = chr(97 + digit) + out
        return out

    rows = spark.createDataFrame([(k,) for k in (0, 25, 26, 27, 701, 702, 18277, 18278, 500_000)], "k long")
    assert all(r.x == letter(r.k) for r in rows.select("k", text.panel_letter(F.col("k")).alias("x")).collect())


def test_tokens(spark):
    row = one(spark, text.inline_tokens(F.col("s")), s=" a  b\nc ")
    assert [(t.t, t.c) for t in row] == [("Space", None), ("Str", "a"), ("Space", None), ("Str", "b\nc "), ("Space", None)]
    assert len(one(spark, text.verbatim_tokens(F.col("s")), s="a   b")) == 5


def test_base64url_turns_back(spark):
    for raw in ("", "a", "ab", "abc", "x" * 200, "ÿþ?~>"):
        packed = one(spark, text.base64url(F.col("s")), s=raw)
        assert "=" not in packed and "\n" not in packed
        assert one(spark, text.from_base64url(F.col("s")).cast("string"), s=packed) == raw
    assert one(spark, text.from_base64url(F.col("s")), s="a+b") is None


@pytest.mark.parametrize(("raw", "want"), [("abc", "abc"), ("a b/c.d-e_f", "a b/c.d-e_f"), ("-x", '"-x"'), ('q"q', '"q\\"q"'), ("", '""')])
def test_yaml_scalars(spark, raw, want):
    assert one(spark, text.yaml_scalar(F.col("s")), s=raw) == want


def test_merged_attributes(spark):
    kv = lambda *p: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in p])
    inner = attributes.attributes(F.lit("i"), F.array(F.lit("a"), F.lit("b")), kv(("x", "1"), ("y", "2")))
    outer = attributes.attributes(F.lit(""), F.array(F.lit("b"), F.lit("c")), kv(("y", "3")))
    got = spark.range(1).select(attributes.merged(inner, outer).alias("m")).first()["m"]
    assert got.id == "i" and got.classes == ["a", "b", "c"] and [(p.k, p.v) for p in got.kv] == [("x", "1"), ("y", "3")]


def test_diagnostics(spark):
    rows = spark.createDataFrame([(1, "comment: x"), (1, "symbol: :a:"), (2, 'inline: unknown node type "q" at row 2, col 7'), (2, "?")], "doc long, m string")
    got = diagnostics.classify(rows, "m", "forward")
    by = {r.m: r for r in got.collect()}
    assert by["comment: x"].severity == "lossy" and by["?"].code is None
    detail = by['inline: unknown node type "q" at row 2, col 7'].details
    assert (detail.node_type, detail.row, detail.column, detail.format) == ("q", 2, 7, None)
    assert {r.doc: r.has_loss for r in diagnostics.loss_gate(got, ["doc"]).collect()} == {1: True, 2: False}


def test_quotes_against_a_stack(spark):
    rows, want = [], set()
    for doc in range(60):
        stack = []
        for at in range(RNG.randint(0, 14)):
            kind, opens = RNG.choice(["S", "D"]), RNG.random() < 0.5
            rows.append((doc, at, kind, opens))
            if opens:
                stack.append((at, kind))
            else:
                for j in reversed(range(len(stack))):
                    if stack[j][1] == kind:
                        want.add((doc, stack[j][0], at, kind))
                        del stack[j:]
                        break
    frame = spark.createDataFrame(rows, "doc int, at long, kind string, opens boolean")
    got = quotes.quote_pairs(frame, ["doc"], "at", F.col("kind"), F.col("opens")).collect()
    assert {tuple(r) for r in got} == want and len(want) > 30


def brute_spans(cells):
    root = {}
    for (r, c), (span, section) in sorted(cells.items()):
        if span == "col" and c > 0:
            root[r, c] = root[r, c - 1]
        elif span == "row" and (r - 1, c) in cells and cells[r - 1, c][1] == section:
            root[r, c] = root[r - 1, c]
        else:
            root[r, c] = (r, c)
    out = {v: [1, 1] for v in root.values()}
    for (r, c), (rr, rc) in root.items():
        if (r, c) != (rr, rc):
            if cells[r, c][0] == "row":
                out[rr, rc][0] = max(out[rr, rc][0], r - rr + 1)
            elif r == rr:
                out[rr, rc][1] = max(out[rr, rc][1], c - rc + 1)
    return {(r, c, *s) for (r, c), s in out.items()}


def test_spans_against_simulation(spark):
    rows, want = [], set()
    for t in range(40):
        cells, section = {}, 0
        for r in range(RNG.randint(1, 6)):
            section += RNG.random() < 0.3
            for c in range(RNG.randint(1, 6)):
                cells[r, c] = (RNG.choice([None, None, "col", "row"]), section)
        rows += [(t, r, c, span, s) for (r, c), (span, s) in cells.items()]
        want |= {(t, *x) for x in brute_spans(cells)}
    frame = spark.createDataFrame(rows, "t int, r int, c int, span string, section int")
    assert {tuple(r) for r in tables.invert_spans(frame, "t", F.col("span"), "section").collect()} == want


def test_resolve_prefers_the_exact_target_then_lower_case_then_the_first(spark):
    targets = spark.createDataFrame([("Intro", 1), ("intro", 2), ("End", 4), ("eND", 3)], "id string, n int")
    refs = spark.createDataFrame([("intro",), ("Intro",), ("INTRO",), ("end",), ("END",), ("none",)], "target string")
    got = {r.target: r.n for r in resolve.resolve(refs, targets, "target", "id", order=["n"]).collect()}
    assert got == {"intro": 2, "Intro": 1, "INTRO": 2, "end": 3, "END": 3, "none": None}
    assert [r.target for r in resolve.unresolved(refs, targets, "target", "id").collect()] == ["none"]


def test_partitions(spark):
    body = lambda h, b: F.array(F.struct(F.lit(h).cast("long").alias("head"), F.lit(b).cast("long").alias("body")))
    fits = lambda *a: spark.range(1).select(tables.partition_fits(F.lit(a[0]), body(a[1], a[2]), F.lit(a[3]), F.lit(a[4])).alias("x")).first()["x"]
    assert fits(1, 0, 3, 1, 5) and not fits(1, 0, 3, 1, 6) and not fits(-1, 0, 5, 1, 5)
