"""Quality rules by weak supervision.

Each rule reads the measures of a whole text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the histogram of vote patterns estimates, without labels, how often texts of either class get each of the three votes of
each rule (Dawid & Skene, 1979) and how common good texts are; the posterior probability of a text's votes decides, instead of a
conjunction of all rules. So a bad vote of a rule that the others do not bear out rejects nothing, and a text may go without one.

A text that fails the base rules is rejected in any case. The model is fitted on the other texts, whose verdict it is.
The histogram has at most 3 ** (number of rules) rows, however large the corpus; it alone comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blocks, bounded, id_text, written

WINDOW = 8
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: What is measured of each text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks", "n_stutter")


def _repeats(words: list[bytes]) -> int:
    """Words that lie in windows of 8 words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    step = 1
    while step < WINDOW:  # rank of the sequence of 2, 4, 8 words that starts at each place
        rank = np.unique((rank[:-step] << 32) | rank[step:], return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = text.encode().split()  # bytes.split cuts at exactly the six ASCII white-space characters
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line and line.strip(_SPACE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    ascii_bytes = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(ascii_bytes, minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    symbols = int(sum(counts[ord(c)] for c in _SYMBOLS))
    spaces = int(sum(counts[ord(c)] for c in _SPACE))
    marks = int(counts[ord("!")] + counts[ord("?")])
    return (len(words), len(text) - spaces, symbols, dup, _repeats(words), lines, len(set(words)), upper, upper + lower, int(counts[48:58].sum()), marks, sum(map(bytes.__eq__, words, words[1:])))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES per row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            rows = [measure(t) for t in part.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), part.column("text")][: 1 + len(MEASURES)], ["doc_id", *MEASURES])

    return bounded(id_text(docs)).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _power(column: str, n: int) -> Column:
    """The n-th power as a product of doubles, the same in every engine."""
    out = x = F.col(column).cast("double")
    for _ in range(n - 1):
        out = out * x
    return out


def rules() -> dict[str, Column]:
    """The votes. Ratios are products, so that every engine decides them alike. What a text of under 20 words cannot show, it abstains from."""
    c = F.col
    long_enough = c("n_words") >= 20
    return {
        "symbols": _vote(100 * c("n_symbols") <= c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "shouting": _vote(long_enough & (4 * c("n_upper") <= c("n_letters")), long_enough & (2 * c("n_upper") > c("n_letters"))),
        "marks": _vote(long_enough & (20 * c("n_marks") < c("n_words")), 4 * c("n_marks") > c("n_words")),
        "repeats": _vote(long_enough & (c("n_repeat_words") == 0), 10 * c("n_repeat_words") > c("n_words")),
        "lines": _vote((c("n_lines") > 2) & (c("n_dup_lines") == 0), (c("n_lines") > 3) & (5 * c("n_dup_lines") > c("n_lines"))),
        # distinct words against a power of all words, as vocabularies grow (Heaps): 0.75 and 0.6, at any length
        "variety": _vote(long_enough & (_power("n_distinct", 4) > _power("n_words", 3)), long_enough & (_power("n_distinct", 5) < _power("n_words", 3))),
        "length": _vote(long_enough & (2 * c("word_chars") >= 9 * c("n_words")) & (c("word_chars") <= 6 * c("n_words")), (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words"))),
        "digits": _vote(long_enough & (20 * c("n_digits") < c("word_chars")), 3 * c("n_digits") > c("word_chars")),
        "letters": _vote(10 * c("n_letters") >= 9 * c("word_chars"), 10 * c("n_letters") < 7 * c("word_chars")),
        "stutter": _vote(long_enough & (50 * c("n_stutter") <= c("n_words")), long_enough & (10 * c("n_stutter") > c("n_words"))),
    }


@dataclass(frozen=True)
class VoteModel:
    """What the votes say: for each rule the log-odds of a good text that a good vote, an abstention and a bad vote add; prior: share of good texts."""

    weights: dict[str, tuple[float, float, float]]
    prior: float

    def posterior(self) -> Column:
        """Probability that a text is good, given its votes."""
        score = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, none, bad) in self.weights.items():
            vote = F.col(f"vote_{name}")
            score = score + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


#: Where the estimates begin: rates of a good vote, an abstention and a bad vote for bad texts and for good ones, the share of good texts, and
#: how many texts that belief is worth. It says only that a bad vote is likelier for a bad text.
START, PRIOR, WORTH = ((0.5, 0.3, 0.2), (0.65, 0.33, 0.02)), 0.85, 2.0
_VOTES = (1, 0, -1)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], names: list[str], tolerance: float = 1e-9, rounds: int = 5000) -> VoteModel:
    """EM for a mixture of good and bad texts in which each rule has its own rates of good votes, abstentions and bad votes in either class.

    Nothing bounds the rates: a rule that fires alike in both classes comes to weigh nothing, one that fires against the others' verdict
    weighs against itself. Rounds go on until no posterior moves by more than the tolerance (rounds is a guard; EM converges). Should the classes have changed places, they are
    put back: the class is called good in which the rules, on average, are right more often than not. Without texts the starting values remain.
    """
    start = np.array(START)
    rates, prior = np.repeat(start[:, None, :], len(names), axis=1), PRIOR
    if patterns:
        votes = np.array([p for p, _ in patterns], int).reshape(len(patterns), len(names))
        n = np.array([k for _, k in patterns], float)
        cast = np.stack([votes == v for v in _VOTES], axis=2).astype(float)
        before = None
        for _ in range(rounds):
            score = math.log(prior / (1 - prior)) + (cast * np.log(rates[1] / rates[0])).sum((1, 2))
            good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            for y, share in enumerate((1 - good, good)):
                rates[y] = ((cast * (share * n)[:, None, None]).sum(0) + WORTH * start[y]) / ((share * n).sum() + WORTH)
            prior = float(((good * n).sum() + WORTH * PRIOR) / (n.sum() + WORTH))
            if before is not None and np.abs(good - before).max() < tolerance:
                break
            before = good
        # mean accuracy of the rules where they vote, under this orientation
        right = prior * rates[1, :, 0] + (1 - prior) * rates[0, :, 2]
        wrong = prior * rates[1, :, 2] + (1 - prior) * rates[0, :, 0]
        if (right / (right + wrong)).mean() < 0.5:
            rates, prior = rates[::-1], 1 - prior
    weights = np.log(rates[1] / rates[0])
    return VoteModel({k: tuple(map(float, w)) for k, w in zip(names, weights, strict=True)}, prior)


def _voted(found: DataFrame) -> DataFrame:
    return found.select("*", base_failed().alias("base_failed"), *(v.alias(f"vote_{k}") for k, v in rules().items()))


def vote_model(votes: DataFrame) -> VoteModel:
    """The model of the texts that the base rules pass."""
    names = list(rules())
    histogram = votes.filter(~F.col("base_failed")).groupBy(*(f"vote_{k}" for k in names)).count().collect()
    return fit_votes(sorted((tuple(r[:-1]), r[-1]) for r in histogram), names)


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the measures, base_failed, the votes, quality (posterior) and kept.

    Null and empty texts have no words and so fail the base rules. Texts of any length are measured whole, one at a time. Repeated rows
    count as often as they stand there. Null ids are kept. An empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    votes = _voted(written(measures(docs), "quality-measures"))
    scored = votes.withColumn("quality", vote_model(votes).posterior())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_filter(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever these are called.

    Each row is measured once and stored with its measures; the model and the verdicts come from that table. So rows are decided where
    they are read, and equal ids do not matter. Null, empty and very long texts, repeated rows and an empty table as in quality_rules.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            found = [measure(t or "") for t in part.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(MEASURES))]
            own = pa.StructArray.from_arrays([part.column(c) for c in range(part.num_columns)], fields=list(part.schema))
            yield pa.RecordBatch.from_arrays([own, *columns], ["row", *MEASURES])

    fields = StructType([StructField("row", schema), *(StructField(m, LongType()) for m in MEASURES)])
    votes = _voted(written(bounded(docs).mapInArrow(run, fields), "quality-rows"))
    scored = votes.withColumn("quality", vote_model(votes.drop("row")).posterior())
    return scored.filter(~F.col("base_failed") & (F.col("quality") >= threshold)).select("row.*")
