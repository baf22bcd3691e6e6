"""Ranked search, whitening and the transducer lexicon against brute force, on nulls, empties, ties, repeats and clashes."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.llm import lexical, transducer, whitening
from tests.llm.test_operators import ROWS, SCHEMA, bag

RNG = random.Random(11)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TEXTS = ["one", "Two two", "é-trois", "a_b", "x0", "\x00y", "zéta", "ﬁn", "the", "The", "of", "rare"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, "k", 1, 2) for r in ROWS], SCHEMA)


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_ranks(docs, items, k):
    known = [(key, Counter(t)) for key, text in docs if (t := terms(text))]
    count, length = len(known), sum(c.total() for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in items:
        found = []
        for place, (key, tf) in enumerate(known):
            score, m = 0, 50 + (50 * tf.total() * count) // length
            for t in set(terms(text)) & tf.keys():
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
            if score:
                found.append((-score, key is None, key or 0, place))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key, _) in enumerate(sorted(found)[:k])]
    return Counter(out)


def weighted_text(n):
    return " ".join(RNG.choices(TEXTS, [2 ** (i % 7) for i in range(len(TEXTS))], k=n))


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_ranked_search_is_exact_at_every_tier(spark, monkeypatch, most_bytes):
    for name, value in (("FIRST", 2), ("GROWTH", 2), ("STEP", 6)):
        monkeypatch.setattr(lexical, name, value)
    docs = [(i, weighted_text(RNG.randint(1, 60))) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, "rare one"), (None, None), (500, None), (501, ""), (502, "-- !"), (503, weighted_text(20_000))]
    items = [(1, "the rare"), (2, "of Two one"), (2, "x0 X0 zéta"), (3, None), (4, ""), (5, "absent"), (None, "ﬁn of the"), (6, " ".join(TEXTS))]
    table = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, term int, item long, w int")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = lexical.top_documents(table.repartition(3), asked, k=5, most_bytes=most_bytes).collect()
    assert bag(tuple(r) for r in got) == brute_ranks(docs, items, 5)


def test_ranked_search_reads_lower_tiers_only_for_items_without_proof(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 4)
    read = []
    monkeypatch.setattr(lexical.Index, "postings", lambda self, upto, f=lexical.Index.postings: read.append(upto) or f(self, upto))
    table = spark.createDataFrame([(i, "common " * (1 + i % 9) + ("rare " * 5 if i < 3 else "")) for i in range(300)], "doc_id long, text string")
    rare = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    assert [r.doc_id for r in lexical.top_documents(table, rare, k=3).orderBy("rank").collect()]
    assert read == [0]
    both = spark.createDataFrame([(1, "common")], "item_id long, text string")
    read.clear()
    got = lexical.top_documents(table, both, k=280).collect()
    assert len(read) > 1 and bag(tuple(r) for r in got) == brute_ranks([tuple(r) for r in table.collect()], [(1, "common")], 280)


def test_ranked_search_goes_on_for_terms_that_stayed_behind(spark, monkeypatch):
    """A term may stay in its tier for a round and fall later, so that one round for each tier is too few."""
    for name, value in (("FIRST", 2), ("GROWTH", 8), ("STEP", 4)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(rng.choice([4, 6, 8]))]
    docs = [(i, " ".join(rng.choices(words, k=1 + int(rng.lognormvariate(1.2, 1))))) for i in range(100)]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    assert bag(tuple(r) for r in lexical.top_documents(table, asked, k=3).collect()) == brute_ranks(docs, [(0, " ".join(words))], 3)


def test_ranked_search_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.top_documents(none, one).count() == 0
    assert lexical.top_documents(one.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0
    twice = lexical.top_documents(one.selectExpr("item_id doc_id", "text", "text"), one.selectExpr("item_id", "text", "item_id"))  # two columns of one name
    assert [r.doc_id for r in twice.collect()] == [1]


VECTORS = [(i, [RNG.gauss(0, 0.2 + d / 7) for d in range(7)]) for i in range(60)]
ODD = [(3, VECTORS[3][1]), (None, [0.5] * 7), (61, [0.1, -0.2]), (62, [])]
UNFIT = [(70, None), (71, [0.1, None]), (72, [float("nan")] * 7), (73, [float("inf")] + [0.0] * 6)]


def brute_whitening(rows, most):
    x = np.array([[math.floor(1024 * np.float32(v)) for v in vec] + [0] * (7 - len(vec)) for _, vec in rows]) + 100_000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - sums / n).T, bias=True))
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return (n * x - sums).astype(object), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True))


@pytest.mark.parametrize("tile", [3, 32])
def test_whitening_is_the_dense_one(spark, tile):
    rows = VECTORS + ODD
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows + UNFIT], "vec_id long, embedding array<float>, component int, v int").repartition(5)
    got = whitening.whiten(table, components=4, tile=tile).collect()
    off, white, explained = brute_whitening(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {len(rows)}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    order = sorted(range(len(rows)), key=lambda i: (str(rows[i][0]), int((off[i] ** 2).sum())))
    for c in range(4):
        mine = sorted((r for r in got if r.component == c + 1), key=lambda r: (str(r.vec_id), int(r.deviation)))
        assert [int(r.deviation) for r in mine] == [int((off[i] ** 2).sum()) for i in order]
        values = np.array([r.whitened for r in mine])
        assert min(np.abs(values - s * white[order, c]).max() for s in (1, -1)) < 1e-8
        assert abs(mine[0].explained - explained[c]) < 1e-9


def test_whitening_without_spread(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, shape)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0])], shape)).collect()
    assert [(r.component, round(abs(r.whitened), 9), r.explained) for r in flat] == [(1, 1.0, 1.0)] * 2
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], shape)).count()


def test_whitening_keeps_large_deviations_exact(spark):
    rows = [(i, [float(s) * 2**39]) for i, s in enumerate((1, -1, 1, 1))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [math.floor(1024 * v[0]) + 100_000 for _, v in rows]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: (4 * a - sum(x)) ** 2 for i, a in enumerate(x)}


def residuals(words):
    """The distinct sets of endings that a prefix of a word can have: as many as a minimal automaton has states."""
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    return {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}


def test_transducer_is_minimal_and_finds_places(tmp_path):
    for letters in (b"ab", b"abcdef"):
        words = sorted({bytes(RNG.choices(letters, k=RNG.randint(1, 6))) for _ in range(80)} | {b"running", b"jumping", b"jumped"})
        arrays = transducer.compiled(words, [[i, i + 1][: 1 + i % 2] for i in range(len(words))])
        with open(tmp_path / "lexicon", "wb") as f:
            for part in (np.array([len(a) for a in arrays]), *arrays):
                f.write(part.astype("<i8").tobytes())
        found = transducer.Lexicon(str(tmp_path / "lexicon"))
        assert len(found.ends) == len(residuals(words))
        probes = [*words, b"", b"zz", b"runnin", b"runningx", *(w + b"a" for w in words), *(w[:-1] for w in words)]
        want = [words.index(p) if p in words else -1 for p in probes]
        assert found.places(pa.array(probes, pa.binary())).tolist() == want
        assert found.places(pa.array(probes, pa.binary())[7:]).tolist() == want[7:]
        i = words.index(b"jumping")
        assert found.ids[found.starts[i] : found.starts[i + 1]].tolist() == [i, i + 1][: 1 + i % 2]


@pytest.fixture(scope="module")
def vocabulary():
    return transducer.load_vocabulary(P.path("byte_bpe_50k.json"), P.PATTERN)


@pytest.mark.parametrize(("most", "block_bytes"), [(0, 500), (20, 1 << 22), (1 << 16, 3000)])
def test_transducer_encoding_is_the_librarys(spark, docs, vocabulary, most, block_bytes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    more = [(400, "<|endoftext|>", None), (401, "a <|endoftext|><|endoftext|>  b", None), (402, "Hello" * 300 + " ", None), (403, "\x00​  x", None), (404, "中文 测试\n\n", None), (405, "<|endoftext|", None)]
    table = docs.select("doc_id", "text", "key", "size").unionByName(spark.createDataFrame([(a, b, "k", 1) for a, b, _ in more], "doc_id long, text string, key string, size int"))
    got = transducer.decode_documents(transducer.encode_documents(table, vocabulary, most=most, block_bytes=block_bytes, most_words=50), vocabulary)
    want = Counter()
    for key, t, _ in ROWS + more:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[key, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert bag((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got.collect()) == want
    assert transducer.encode_documents(table.limit(0), vocabulary).count() == 0


def test_long_words_merge_as_short_ones(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for word in ("a" * 3000, "ab" * 400, "".join(RNG.choices("etaoin", k=2000)), "the" * 40):
        assert vocabulary.encode(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_words_merged_side_by_side_are_the_ones_merged_alone(vocabulary):
    tokens = list(vocabulary.ids)
    words = [b"".join(RNG.choices(tokens, k=RNG.randint(1, 4))) for _ in range(500)] + [b"a" * n for n in range(120)] + [bytes(RNG.randrange(256) for _ in range(n)) for n in range(50)]
    flat, sizes = transducer.Merger(vocabulary).encode_all(words)
    alone = [vocabulary.encode(w) for w in words]
    assert sizes.tolist() == [len(a) for a in alone] and flat.tolist() == [i for a in alone for i in a]
    assert [len(x) for x in transducer.Merger(vocabulary).encode_all([])] == [0, 0]


def test_decoding_of_any_ids_is_the_librarys(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lists = [[RNG.randrange(50_257) for _ in range(RNG.randint(0, 30))] for _ in range(50)] + [[RNG.randrange(256) for _ in range(40)]]
    table = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)] + [(99, None)], "i int, ids binary")
    got = {r.i: r.decoded for r in transducer.decode_documents(table, vocabulary).collect()}
    assert got == {**{i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}, 99: None}


def test_frequent_words_are_counted_over_all_rows(spark, vocabulary):
    rows = spark.createDataFrame([(t,) for t in ["a b b", " b", "b", "<|endoftext|> b", "c  c"]], "text string")
    got = {bytes(r.word).decode(): r.n for r in transducer.word_counts(rows, vocabulary, block_bytes=4).collect()}
    assert got == {"a": 1, " b": 4, "b": 1, "c": 1, " ": 1, " c": 1}
