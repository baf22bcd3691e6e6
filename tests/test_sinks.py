"""Sources, sinks and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from docweft.operators import diagnostics, forward
from docweft.sources import gate, sinks
from docweft.sources.nodes import flatten, read_documents, read_lines
from docweft.streaming import convert


def ast(word):
    return json.dumps({"type": "document", "children": [{"type": "paragraph", "children": [{"type": "text", "value": word}, {"type": "symbol", "name": "sun"}]}]})


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(ast("x"))
    (tmp_path / "symbols.json").write_text('{"sun": "☼", "moon": "☾"}')
    nodes, errors = flatten(read_documents(spark, str(tmp_path / "docs")))
    out = forward.convert(nodes, sinks.read_symbols(spark, str(tmp_path / "symbols.json")))
    sinks.write_documents(out, str(tmp_path / "out"))
    line, = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert line["blocks"] == [{"t": "Para", "c": [{"t": "Str", "c": "x☼"}]}] and errors.count() == 0


def test_losses_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("d", "comment: x"), ("d", "comment: y"), ("e", "symbol: :a:")], "doc string, m string")
    found = diagnostics.classify(rows, "m", "carve-to-pandoc")
    sinks.write_diagnostics(found, str(tmp_path / "said"))
    assert {r.code for r in spark.read.json(str(tmp_path / "said")).collect()} == {"comment-dropped", "symbol-unresolved"}
    assert sinks.refuse_losses(found.where("doc = 'e'")).count() == 1
    with pytest.raises(sinks.LossError, match="comment-dropped: 2"):
        sinks.refuse_losses(found)
    with pytest.raises(Exception, match="no rule knows"):
        diagnostics.classify(rows.select("doc", F.lit("what").alias("m")), "m", "d", strict=True).collect()


def test_gated_sink(spark, tmp_path):
    """One job commits both outputs or leaves nothing behind."""
    rows = spark.createDataFrame([("d", "comment: x"), ("d", "comment: y"), ("e", "symbol: :a:")], "doc string, m string")
    found = diagnostics.classify(rows, "m", "carve-to-pandoc").repartition(3)
    docs = spark.createDataFrame([("d", '{"a":"é"}'), ("d", '{"a":"é"}'), ("e", "{}"), ("f", None)], "doc string, json string").repartition(2)
    out = str(tmp_path / "out")
    lines = lambda name: sorted(r.value for r in spark.read.text(f"{out}/{name}").collect())
    with pytest.raises(sinks.LossError, match="^comment-dropped: 2$"):
        gate.write_gated(docs, found, out)
    assert not list(tmp_path.glob("out/*"))
    gate.write_gated(docs, found.where("doc = 'e'"), f"file:{out}")
    assert lines("documents") == ['{"a":"é"}', '{"a":"é"}', "{}"] and [json.loads(x)["code"] for x in lines("diagnostics")] == ["symbol-unresolved"]
    gate.write_gated(docs.where("doc = 'e'"), found, out, allow_loss=True)
    assert len(lines("documents")) == 4 and len(lines("diagnostics")) == 4
    gate.write_gated(docs.limit(0), found.limit(0), f"{out}/none")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["diagnostics", "documents", "none"] and not list((tmp_path / "out/none").glob("*/*"))
    broken = docs.withColumn("json", F.when(F.col("doc") == "e", F.raise_error(F.lit("broken off"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="broken off"):
        gate.write_gated(broken, found, f"{out}/broken", allow_loss=True)
    assert not list(tmp_path.glob("out/broken/*"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"doc": f"{part}{i}", "ast": ast(f"w{i}") if i else "{"}) for i in range(3)))
        convert.convert_stream(convert.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.doc for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert got == {"01", "02", "11", "12"} and spark.read.parquet(str(tmp_path / "out/errors")).count() == 2
    assert read_lines(spark, str(tmp_path / "in")).count() == 6
