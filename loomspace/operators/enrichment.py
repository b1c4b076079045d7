"""Prompts and descriptions of concepts from the chunks that say most about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import holding


def chunk_signal(cut: DataFrame, strong: DataFrame) -> DataFrame:
    """(source, doc_id, start, signal): the strengths of the source's high-value terms that the lower-cased chunk contains as a substring, summed.

    strong: (source, term, strength); the cap of terms per source bounds what each chunk is held against.
    """
    return holding.signals(cut, strong)


def term_chunks(cut: DataFrame, strong: DataFrame, kept: DataFrame, max_n: int = 3, n: int = 5) -> DataFrame:
    """(source, term, doc_id, start, signal, rank): of each kept term of a source the n chunks that hold it with most signal, ties in order.

    kept: (source, term), bounded per source by its cap. One pass over the chunks gives both their signal and which kept terms they hold; a task
    sends the n best of each term that it has seen.
    """
    order = Window.partitionBy("source", "term").orderBy(F.round("signal", 9).desc(), "doc_id", "start")
    return holding.best_chunks(cut, strong, kept, max_n, n).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def summary_prompt(raw_term: Column, context: Column) -> Column:
    """The published wording of the summary prompt: a fixed format."""
    return F.concat(
        F.lit('You are summarizing a text document.\nWrite exactly one sentence describing what "'),
        raw_term,
        F.lit('" refers to in the excerpts below.\nUse only information explicitly present in the text — do not interpret, infer, or add outside knowledge.\nIf the excerpts do not clearly describe "'),
        raw_term,
        F.lit('", write: "This text mentions '),
        raw_term,
        F.lit(' without a clear description."\n\nTEXT EXCERPTS:\n'),
        context,
        F.lit('\n\nOne sentence description of "'),
        raw_term,
        F.lit('" based only on the text above:'),
    )


def name_prompt(description: Column) -> Column:
    """The published wording of the naming prompt: a fixed format."""
    return F.concat(
        F.lit('Based on this description, give a short 1-3 word name that captures what this concept is about.\nDo not use generic words like "time", "one", "first", "number".\nUse specific meaningful terms from the description.\n\nDescription: '),
        description,
        F.lit("\n\nRespond with ONLY the name, nothing else. 2-3 words maximum:"),
    )


def answer_prompt(question: Column, facts: Column) -> Column:
    """The published wording of the question prompt; facts: lines of `- term: description`. A fixed format."""
    return F.concat(
        F.lit("Answer the following question using only the facts provided below.\nDo not use outside knowledge. If the facts do not contain enough information, say so.\n\nFACTS:\n"),
        facts,
        F.lit("\n\nQUESTION: "),
        question,
        F.lit("\n\nANSWER:"),
    )


def joined(rows: DataFrame, keys: list[str], order: list[str], value: str, by: str, name: str) -> DataFrame:
    """keys and `name`: the values in order, joined. Groups are bounded by the ranks that the caller kept."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["_v"]), by).alias(name))
