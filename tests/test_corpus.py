"""Corpus counts, HTML in normal form, and differences of trees, against plain loops and by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docweft.operators import corpus, difference
from docweft.sources.nodes import flatten
from tests.test_forward import para, t

RNG = random.Random(3)
LINES = ["::: compare", "  :::: compare x y ", ":::", "::::", ":::::", "text", "", "::: comparex", "::: compare\t", ":: compare", None]


def brute_declared(lines):
    marker, n = None, 0
    for raw in lines:
        line = (raw or "").strip()
        if marker is not None:
            marker = None if line == marker else marker
        elif re.fullmatch(r":{3,}\s+compare(\s+\S.*)?", line):
            n, marker = n + 1, re.match(":+", line)[0]
    return n


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_declared_blocks_in_ranges_of_any_size(spark, size):
    docs = {k: [RNG.choice(LINES) for _ in range(RNG.randint(1, 120))] for k in [*range(25), None]}
    rows = [(k, i, line) for k, lines in docs.items() for i, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc int, at long, line string")
    got = {r.doc: r.declared for r in corpus.declared_blocks(frame, "doc", "at", "line", size=size).collect()}
    assert got == {k: brute_declared(lines) for k, lines in docs.items()} and sum(got.values()) > 50
    assert corpus.declared_blocks(frame.limit(0), "doc", "at", "line").count() == 0


def test_shortfalls(spark):
    rows = spark.createDataFrame([("a", 3, 3), ("b", 2, 3), ("c", None, 0), ("d", -1, 0)], "label string, n int, least int")
    assert {(r.label, r.finding) for r in corpus.shortfalls(rows, "label", "n", "least").collect()} == {("b", "b: 2 of 3"), ("c", "c: no count at all"), ("d", "d: no count at all")}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('<a  href="x"\n class="c">t</a>', '<a class="c" href="x">t</a>'), ("<p>\n\n a  b </p>\n", "<p> a b </p>"), ('<i z b="1 > 0 <u y a>" a />', '<i a b="1 > 0 <u y a>" z/>'),
        ('<img src="q"   alt/>', '<img alt src="q"/>'), ("a < b and c > d", "a < b and c > d"), ('<x data-b="2" data-a="1"><y k="v">', '<x data-a="1" data-b="2"><y k="v">'), ("", ""), ("\u0001<b q p>", "<b p q>"),
    ],
)
def test_normal_html(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "h string").select(corpus.normal_html(F.col("h"))).first()[0] == want


def trees(spark, docs):
    rows = [(k, json.dumps({"type": "document", "children": children})) for k, children in docs.items()]
    return flatten(spark.createDataFrame(rows, "doc string, ast string"))[0]


def test_differences_at_their_tops(spark):
    quote = lambda *x: {"type": "block_quote", "children": list(x)}
    same = [para(t("a")), quote(para(t("b")), {"type": "heading", "level": 2, "children": [t("c")]})]
    before = trees(spark, {"same": same, "changed": same, "missing": same, "gone": same, "spelled": [{"type": "list", "tight": True, "bulletChar": "*", "items": []}], "attrs": [para(attrs={"keyValues": {"a": "1", "b": "2"}})]})
    after = trees(spark, {
        "same": same, "changed": [para(t("A")), quote(para(t("b")), {"type": "heading", "level": 3, "children": [t("c")]})], "missing": [para(t("a")), quote(para(t("b")))], "new": same,
        "spelled": [{"type": "list", "tight": True, "bulletChar": "-", "items": []}], "attrs": [para(attrs={"keyValues": {"b": "2", "a": "1"}})],
    })
    found = difference.differences(before, after)
    got = {(r.doc, r.path, r.before is None, r.after is None) for r in found.collect()}
    assert got == {
        ("changed", "children[0]/children[0]", False, False), ("changed", "children[1]/children[1]", False, False), ("missing", "children[1]/children[1]", False, True), ("gone", "", False, True), ("new", "", True, False),
    }
    ledger = spark.createDataFrame([("gone", ""), ("missing", "children[9]")], "doc string, path string")
    new, fixed = difference.unknown(found, ledger)
    assert {(r.doc, r.path) for r in new.collect()} == {x[:2] for x in got} - {("gone", "")}
    assert [tuple(r) for r in fixed.collect()] == [("missing", "children[9]")]
    assert difference.differences(before, before).count() == 0
