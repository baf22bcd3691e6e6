"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from docweft.llm import bpe, components, line_dedup, lm, lm_filter, mixing, quality_classifier, quality_rules, simhash, topk, toxicity, weak
from docweft.llm.common import in_training

RNG = random.Random(5)
VOCAB = ["alpha", "Beta", "gamma,", "δelta", "don't", "123", "x", "the", "of", "…", "größe", "end.", "naïve"]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def some_rows():
    base = [text(RNG.randint(1, 80)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(10)]  # exact copies
    rows += [(200 + i, base[i] + " tail", None) for i in range(5)]
    rows += [(300, None, "s1"), (301, "", None), (302, "  \n\t ", "s2"), (None, "no key here", "s0"), (None, "nor here\nno key here\nthe line of a row without key", "s0"), (303, "a  b   c \n\n d e ", "s1")]
    rows += [(0, base[0], "s0"), (0, base[0], "s0"), (304, text(20_000), "s2"), (305, "<|endoftext|> x<|endoftext|>", "s1"), (306, "a" * 5000, "s1")]
    rows += [(307, "one\ntwo\none\n\n" + "long enough line of words to be near another\n", "s1"), (308, "long enough line of words to be near anothex\nthree", "s1")]
    return rows


ROWS = some_rows()
SCHEMA = "doc_id long, text string, source string, score double, key string, size int, block int"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "docs")
    spark.createDataFrame([(*r, 0.5, "k", 1, 2) for r in ROWS], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_pieces_keep_the_pretokens():
    import regex

    match = regex.compile(P.PATTERN).findall
    cut = bpe.pretokens_of_piece(P.PATTERN)
    for _ in range(500):
        t = "".join(RNG.choice(["a", "B ", " ", "  ", "\n", "\t", "'s", "1", ".", "é", " ", " ", "!!", "中"]) for _ in range(RNG.randint(0, 12)))
        first, *rest = bpe.pieces(t)
        assert [w for p in [first, *(" " + p for p in rest)] if p for w in cut(p)] == match(t), repr(t)


def test_encoding_is_the_librarys_and_decodes(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for key, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want[key, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    for block_bytes in (500, 1 << 24):
        got = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN, block_bytes=block_bytes), path)
        assert bag((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
        fused = bpe.encode_documents(docs, path, P.PATTERN, block_bytes=block_bytes, decode=True)
        assert bag((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in fused.collect()) == want
    for decode in (False, True):
        assert bpe.encode_documents(empty, path, P.PATTERN, decode=decode).count() == 0


def test_columns_of_one_name(docs):
    """Of two columns of one name the first counts, and both stay."""
    twice = docs.select("doc_id", "text", "source", F.lit("x").alias("text"), F.lit(-1).alias("doc_id"), F.lit("y").alias("source"))
    for made in (line_dedup.deduplicate, mixing.mixed):
        got, want = made(twice), made(docs)
        assert got.columns == twice.columns
        assert bag(map(tuple, got.toDF(*"abcdef").select("a", "b", "c").collect())) == bag(map(tuple, want.select("doc_id", "text", "source").collect()))


def test_token_counts_are_the_librarys(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for key, t, _ in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[key, len((t or "").encode()), n, n > 1024] += 1
    assert bag(bpe.token_counts(docs, path, P.PATTERN).collect()) == want
    assert bpe.token_counts(empty, path, P.PATTERN).count() == 0


def brute_print(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash_components(docs, empty):
    prints = [brute_print(t) for _, t, _ in ROWS]
    roots = brute_components(prints, 3)
    least = {}
    for (key, _, _), r in zip(ROWS, roots, strict=True):
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    want = Counter((key, p, least[r]) for (key, _, _), p, r in zip(ROWS, prints, roots, strict=True))
    got = simhash.near_duplicates(docs)
    assert bag((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(k for k in set(least.values()) if k is not None)
    assert kept.where("doc_id IS NULL").count() == sum(v is None for v in least.values())


def test_one_of_each_takes_any_columns(spark):
    rows = [(1, "a b c d", {"x": 1}, 5, "u"), (1, "a b c d", {"y": 2}, 4, "v"), (2, "A b c d", None, 1, "w"), (3, None, None, None, None), (4, "", {}, 0, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, hash int, k string").toDF("doc_id", "text", "more", "hash", "hash")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(tuple(r)[0] for r in kept.collect()) == [1, 3]
    assert [tuple(r)[3:] for r in kept.collect() if r[0] == 1] == [(4, "v")]


def test_groups_without_a_key_of_their_own_each_keep_a_row(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag(kept) == bag([rows[0], rows[1], rows[3], rows[4]])


def test_links_of_crowded_postings(spark):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 2**63, 12)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in center for _ in range(60)}
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for block in (16, 2048):
        found = {r.node: r.root for r in components.connected_components(simhash.links(frame, block=block)).collect()}
        roots = brute_components(values, 3)
        groups = lambda label: {frozenset(v for v, x in zip(values, label, strict=True) if x == y) for y in set(label)}
        assert groups([found.get(v, v) for v in values]) == groups(roots)


def test_every_five_bytes_hold_a_posting():
    from itertools import combinations

    for size in (3, 4, 5):
        sets = simhash.covering_sets(5, size)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 5))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_banded_distance(spark, k):
    rows = []
    while len(rows) < 150:
        a = "".join(RNG.choice("abé𝄞") for _ in range(RNG.randint(0, 14)))
        b = list(a)
        for _ in range(RNG.randint(0, k + 2)):
            i = RNG.randint(0, len(b))
            b[i : i + RNG.randint(0, 1)] = RNG.choice(["", "a", "c", "é"])
        if abs(len(a) - len(b)) <= k:
            rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("d"))
    assert all(min(r.d, k + 1) == min(lev(r.a, r.b), k + 1) for r in got.collect())


@pytest.mark.parametrize("k", [1, 2])
def test_near_lines(spark, k):
    lines = {"".join(RNG.choice("ab ") for _ in range(RNG.randint(6, 10))) for _ in range(400)}
    lines = sorted(s for s in lines if s.strip())
    frame = spark.createDataFrame([(s, i % 7) for i, s in enumerate(lines)], "line string, owner long")
    got = {frozenset((r.first.line, r.second.line)) for r in line_dedup.near_pairs(frame, k, 6).collect()}
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and lev(a, b) <= k}
    assert got == want and len(want) > 20


def brute_lines(rows, k, min_chars):
    last = (1 << 63) - 1
    owner = {}
    for key, t, _ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\v\f\r"):
                owner[line] = min(owner.get(line, last), last if key is None else key)
    long_ = [s for s in owner if len(s) >= min_chars]
    near = {b for a in long_ for b in long_ if (owner[a], a) < (owner[b], b) and abs(len(a) - len(b)) <= k and lev(a, b) <= k}
    return owner, near


def test_line_dedup(docs, empty):
    rows = [r for r in ROWS if len(r[1] or "") < 3000]
    owner, near = brute_lines(rows, 1, 24)
    small = docs.where("text IS NULL OR length(text) < 3000")
    last = (1 << 63) - 1
    want = Counter()
    for key, t, _ in rows:
        out, seen = [], set()
        for line in (t or "").split("\n"):
            if not line.strip(" \t\n\v\f\r"):
                out.append(line)
            elif owner[line] == (last if key is None else key) and line not in near and line not in seen:
                out.append(line)
            seen.add(line)
        want[key, None if t is None else "\n".join(out)] += 1
    got = line_dedup.deduplicate(small)
    assert got.columns == docs.columns
    assert bag(got.select("doc_id", "text").collect()) == want and near
    report = {r.doc_id: r for r in line_dedup.line_report(small).collect()}
    assert report[308].n_near == 1 and report[307].n_lines == 4 and report[300].n_lines == 0
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.deduplicate(empty).count() == 0


def brute_positions(r, rank, source):
    """(time, key, source) of each copy that the mix takes of a row: the middle of its words, in words of its source's demand."""
    knots = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))[rank % 3]
    out = []
    for lap in range(2):
        begins = lap * r.source_size + r.first_at
        if r.size and begins < math.floor(r.target):
            share, low, high = min((begins + r.size / 2) / r.target, 1.0), 0.0, 1.0
            for _ in range(60):  # the integral of the weight up to t is met by bisection
                t = (low + high) / 2
                done = knots[0][1] * t + (knots[1][1] - knots[0][1]) * t * t / 2
                low, high = (t, high) if done < share else (low, t)
            out.append((low, r.doc_id, source))
    return out


def test_mixing_meets_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = Counter()
    source = {(k, len((t or "").encode().split())): s for k, t, s in ROWS}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == math.floor(target[s]) for s in order)
    assert bag(mixing.mix(docs).collect()) == bag(got)
    times = [r.position for r in got if r.position is not None]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    least = {}  # equal rows share the laps of the first of them
    for r in got:
        least[r.doc_id, r.size] = min(least.get((r.doc_id, r.size), r), r, key=lambda x: x.first_at)
    laps = [x for r in got for x in brute_positions(least[r.doc_id, r.size], order.index(source[r.doc_id, r.size]), source[r.doc_id, r.size])]
    for r in got:
        first = brute_positions(r, order.index(source[r.doc_id, r.size]), None)
        assert (r.position is None) == (r.taken == 0) and (r.taken == 0 or math.isclose(r.position, first[0][0], abs_tol=1e-9))
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert [(r.doc_id, r.source) for r in rows.collect()] == [(k, s) for _, k, s in sorted(laps, key=lambda x: x[0])]
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_schedules_invert(spark):
    knots = ((0.0, 2.0), (0.25, 0.5), (0.5, 0.5), (1.0, 1.0))
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).select("u", mixing.time_of(F.col("u"), knots).alias("t")).collect()
    for r in rows:
        done = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            x = min(max(r.t, t0), t1)
            done += (x - t0) * (a + a + (b - a) * (x - t0) / (t1 - t0)) / 2
        assert math.isclose(done / mixing.area(knots), r.u, abs_tol=1e-9)


def test_lm_base_is_exact(docs, empty):
    train = in_training(F.col("doc_id"), 7, 2)
    tokens = [(k, [*(t or "").encode().lower().split(), b""]) for k, t, _ in ROWS]
    counts = Counter()
    for k, w in tokens:
        if k is not None and zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if k is None else k, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w in tokens)
    for block_bytes in (400, 1 << 24):
        rows = lm.score(docs, train, block_bytes=block_bytes).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == want
    assert all(r.score <= 0 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score(empty, train).count() == 0


def brute_scores(rows, m=200.0):
    """Scores with quantised counts of pairs, and no false positives."""
    tokens = [(k, [*(t or "").encode().lower().split(), b""]) for k, t, _ in rows]
    ones, twos = Counter(), Counter()
    for k, w in tokens:
        if k is not None and zlib.crc32(str(k).encode()) % 7 != 2:
            ones.update(w)
            twos.update(zip([b"", *w], w, strict=False))
    n, v = sum(ones.values()), len(ones)

    def middle(count):
        level = max((i for i in range(100) if math.ceil(2 ** (i / 2) - 1e-9) <= count), default=None)
        if level is None:
            return 0
        low, high = (math.ceil(2 ** (i / 2) - 1e-9) for i in (level, level + 1))
        return (low + high - 1) / 2

    p = lambda h, x: (min(middle(twos[h, x]), ones[h], ones[x]) + m * (ones[x] + 1) / (n + v + 1)) / (ones[h] + m)
    scores = [(k, len(w), round(sum(math.log10(p(h, x)) for h, x in zip([b"", *w], w, strict=False)), 4)) for k, w in tokens]
    return Counter(scores), sum(p(b"the", x) for x in ones) + m / (n + v + 1) / (ones[b"the"] + m)


def test_lm_scores_by_quantised_counts_in_bounded_shards(docs):
    train = in_training(F.col("doc_id"), 7, 2)
    want, whole = brute_scores(ROWS)
    for block_bytes, shard_bytes in ((400, 500), (1 << 24, 300), (3000, 1 << 23)):
        got = lm.score(docs, train, block_bytes=block_bytes, shard_bytes=shard_bytes, bits_a_member=200).collect()
        assert Counter((r.doc_id, r.n_tokens, round(r.score, 4)) for r in got) == want
    assert abs(whole - 1) < 0.05  # all known words and one unknown word after one word
    close = lm.score(docs, train).collect()
    assert abs(sum(r.score for r in close) / sum(s * n for (_, _, s), n in want.items()) - 1) < 0.01


def test_lm_gibberish_scores_below_held_out_text(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    zipf = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, zipf, k=60))) for i in range(400)]
    rows += [(1000 + i, " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(5)) for _ in range(60))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") < 360).collect()}
    assert max(got[1000 + i] for i in range(40)) < min(got[i] for i in range(360, 400))


def test_lm_unknown_words_cost_more_than_known_ones(spark, tmp_path):
    rows = [(i, " ".join(f"rare{j}" for j in range(40 * i, 40 * i + 40))) for i in range(30)] + [(1000, "rare5"), (1001, "never")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r.score for r in lm.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") < 1000).collect()}
    assert got[1001] < got[1000]


def test_lm_gathers_pairs_of_rare_words(spark, tmp_path):
    rows = [(i, " ".join(f"rare{j}" for j in range(40 * i, 40 * i + 40))) for i in range(30)] + [(1000, "rare5 rare6"), (1001, "rare5 rare8")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r.score for r in lm.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 0.1


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.maximum(1, (rng.pareto(1, 3000) * 2).astype(int))
    levels = lm_filter.level_of(counts)
    assert lm_filter.level_of(np.arange(9)).tolist() == [0, 1, 2, 3, 4, 4, 5, 5, 6] and lm_filter.count_of(np.arange(7)).tolist() == [0, 1, 2, 3, 4.5, 6.5, 9.5]
    assert (np.abs(lm_filter.count_of(levels) / counts - 1) < 0.25).all()
    grams = lm_filter.Filter(keys, levels)
    got = grams.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    assert (grams.levels(rng.integers(0, 2**63, 3000).astype(np.uint64)) == 0).mean() > 0.97
    assert len(grams.bits) * 8 <= levels.sum() * 12 + 8 and not lm_filter.Filter(keys[:0], levels[:0]).levels(keys).any()


def brute_measures(t):
    w = (t or "").encode().split()
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [s for s in (t or "").split("\n") if s.strip(" \t\n\v\f\r")]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_measures(docs, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.judged(docs)
    want = Counter()
    for k, t, _ in ROWS:
        m = brute_measures(t)
        want[(k, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert bag(got.select("doc_id", *names, "base_failed").collect()) == want
    assert got.where("kept AND base_failed").count() == 0 and quality_rules.judged(empty).count() == 0


def test_votes_tell_good_from_bad(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.8
    votes = [[(int(rng.choice([-1, 1], p=[0.15, 0.85])) * (1 if g else -1)) if rng.random() < 0.8 else None for _ in range(6)] for g in truth]
    frame = spark.createDataFrame([(i, *v) for i, v in enumerate(votes)], "i int, " + ", ".join(f"v{j} int" for j in range(6)))
    model = weak.fit_votes(frame, [f"v{j}" for j in range(6)])
    got = {r.i: r.z > 0 for r in frame.select("i", weak.log_odds(model).alias("z")).collect()}
    assert np.mean([got[i] == bool(g) for i, g in enumerate(truth)]) > 0.95 and abs(model.prior - 0.8) < 0.05


def labelled_texts(n, junk, every):
    rows = []
    for i in range(n):
        bad = i % every == 0
        rows.append((i, text(60) + (" " + junk if bad else "") + " " + text(10), int(bad)))
    return rows


def test_toxicity_learns(spark, docs, empty):
    rows = labelled_texts(600, "vile scum idiot", 4)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    model = toxicity.fit(frame.drop("toxic"), labels, may_learn=in_training(F.col("doc_id"), 5, 0))
    twice = toxicity.score(frame.withColumn("score", F.lit("old")), model)
    assert twice.columns == [*frame.columns, "score"] and dict(twice.dtypes)["score"] == "double"
    scored = toxicity.score(frame, model).where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in scored]) > 0.95
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and kept.where("toxic = 0").count() > 0.95 * 450 > kept.where("toxic = 1").count()
    same = toxicity.score(docs, model, into="more").collect()
    assert len(same) == len(ROWS) and all(0 <= r.more <= 1 for r in same)
    nothing = toxicity.fit(docs, labels.where("false"))
    assert toxicity.without_toxic(docs, nothing).count() == len(ROWS)
    assert toxicity.without_toxic(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))).count() == len(ROWS)
    assert all(r.more == 0.5 for r in toxicity.score(docs, nothing, into="more").collect())
    assert toxicity.score(empty, model).count() == 0


def test_quality_classifier_learns(spark, docs, empty):
    rows = [(i, text(80) if i % 3 else " ".join(w.upper() + "!! $$$" for w in text(60).split()), i % 3 > 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model, _ = quality_classifier.fit(frame.drop("good"))
    got = {r.doc_id: r.kept for r in quality_classifier.score(frame, model).collect()}
    assert np.mean([got[i] == g for i, _, g in rows]) > 0.95
    assert quality_classifier.score(docs, model).count() == len(ROWS)
    assert quality_classifier.score(empty, quality_classifier.fit(empty)[0]).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=20)], 1) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1], 2) for i in range(30)]  # ties
    rows += [(50, rows[50][1], 3), (50, rows[51][1], 3), (7, rows[7][1], 3), (7, rows[9][1], 3)]  # repeated rows and keys
    rows += [(2000, None, 0), (2050, [1.0, None], 0), (2100, [float("nan")] * 20, 0), (2150, [float("inf")] * 20, 0), (2200, [1.0, 2.0], 0), (None, [1.0] * 20, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    got = topk.exact_top_k(frame, F.col("vec_id") % 50 == 0, block=64, queries=4).collect()
    usable = []
    for k, v, _ in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * float(np.float32(x))) for x in v]
            usable.append((k, w + [0] * (20 - len(w))))
    want = Counter()
    for i, (q, x) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), k) for j, (k, v) in enumerate(usable) if j != i)[:5]
            want.update((q, r + 1, k, -s) for r, (s, k) in enumerate(best))
    assert bag(got) == want
    assert topk.exact_top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_joins_and_broadcasts_nothing(spark):
    """Candidates are dealt out once and queries come to them in packs, so that no group of queries has to fit a row or the driver."""
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)], "vec_id long, embedding array<float>")
    found = topk.exact_top_k(frame, F.col("vec_id") % 2 == 0, block=16, queries=8, spread=2, share_bytes=1 << 12)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert bag(found.collect()) == bag(topk.exact_top_k(frame, F.col("vec_id") % 2 == 0).collect())
    assert found.count() == 750


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 1000 for j in range(1000, 1100)) and len(got) == 161


def test_queries_agree_with_their_sql(spark):
    from pathlib import Path

    import duckdb

    from docweft.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, folder)
        columns = ", ".join(sorted(frame.columns))
        want = Counter(tuple(map(str, r)) for r in con.sql(f"SELECT {columns} FROM ({sql})").fetchall())
        assert Counter(tuple(map(str, r)) for r in frame.select(*sorted(frame.columns)).collect()) == want, name
