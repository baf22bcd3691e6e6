"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides."""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import keyed, saved, text_pass
from docweft.llm.weak import fit_votes, log_odds

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_RUN = re.compile(r"([!-/:-@\[-`{-~])\1+")
_SYMBOL, _SPACE = re.compile("[" + re.escape(SYMBOLS) + "]"), " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_distinct", "n_stops", "n_runs", "n_stutters")


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text.

    n_words, word_chars: words and their code points; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in 3-word windows that occur twice or more, first included;
    n_upper: words in capitals; n_lines: lines with a word; n_distinct: distinct words; n_stops: lines that end a sentence;
    n_runs: runs of one punctuation character; n_stutters: words equal to the one before.
    """
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode().split()
    words = [w.decode() for w in raw]
    lines = [s for s in text.split("\n") if s.strip(_SPACE)]
    n, covered = len(raw), 0
    if n > 2:
        windows = list(zip(raw, raw[1:], raw[2:], strict=False))
        times = Counter(windows)
        if len(times) < len(windows):
            end = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    covered += i + 3 - max(i, end)
                    end = i + 3
    return (
        n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), covered,
        sum(map(str.isupper, words)), len(lines), len(set(raw)), sum(s.rstrip(_SPACE)[-1:] in '.!?"' for s in lines),
        len(_RUN.findall(text)), sum(map(eq, raw, raw[1:])),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, MEASURES) for every row; a null text has no words. Repeated rows and null keys come out as they came in."""

    def each(texts):
        return [pa.array(c, pa.int64()) for c in (zip(*map(measures, texts), strict=True) if texts else [()] * len(MEASURES))]

    return text_pass(keyed(docs, key, text), [T.StructField(m, T.LongType()) for m in MEASURES], each)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, null to abstain. Most see one kind of fault and say nothing without it.

    Each fault is seen by two rules or more, so that expectation-maximisation can tell them from chance by their overlap.
    """
    n, c = F.col("n_words"), F.col
    bad = lambda condition: F.when(condition, -1)
    faultless = (20 * c("n_runs") <= n) & (50 * c("n_symbols") <= n) & (4 * c("n_upper") <= n) & (10 * c("n_stutters") <= n)
    return {
        "symbols": bad(10 * c("n_symbols") > n),
        "symbol_share": bad(50 * c("n_symbols") > c("word_chars")),
        "runs": bad(10 * c("n_runs") > n),
        "capitals": bad(2 * c("n_upper") > n),
        "loud": bad((10 * c("n_runs") > n) & (2 * c("n_upper") > n)),
        "repeats": bad(10 * c("n_repeat_words") > 3 * n),
        "stutters": bad(5 * c("n_stutters") > n),
        # Vocabulary grows about as the root of the length, so the bound does at every length.
        "distinct": bad((n >= 20) & (c("n_distinct") * c("n_distinct") < 5 * n)),
        "line_copies": bad((c("n_lines") >= 4) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        "sentence_ends": F.when((c("n_lines") >= 3) & (10 * c("n_stops") < 3 * c("n_lines")), -1).when(10 * c("n_stops") > 7 * c("n_lines"), 1),
        "word_length": F.when((10 * c("word_chars") < 25 * n) | (c("word_chars") > 12 * n), -1).when((c("word_chars") > 3 * n) & (c("word_chars") < 9 * n), 1),
        "flow": F.when(faultless, 1),
    }


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """(key, MEASURES, base_failed, posterior, kept) for every row.

    base_failed: under 50 words, or over half of them in repeated windows. posterior: probability of good quality from
    the rules' votes, whose reliabilities expectation-maximisation finds from the counts of all vote patterns (at most
    3 to the number of rules, whatever the input). kept: not base_failed and posterior >= at. A text without words,
    a null one too, has base_failed and no vote. Repeated rows and null keys come out as they came in, each with votes of
    its own. An empty table gives no rows.
    """
    rows = saved(measured(docs, key, text))
    votes = {f"vote_{k}": v for k, v in rules().items()}
    voted = rows.select("*", *[v.alias(k) for k, v in votes.items()])
    model = fit_votes(voted.where("n_words > 0"), list(votes))
    posterior = 1 / (1 + F.exp(-log_odds(model)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.select(F.col("key").alias(key), *MEASURES, failed.alias("base_failed"), posterior.alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= at))
