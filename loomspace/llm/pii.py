"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction, in DataFrame operations alone.

Seeds are the spans of the base patterns. Candidates are runs of tokens with a digit or an @. Each stands in two lexical patterns: the two words before
it, and the word on either side of it. Over the graph of patterns and instances (distinct values) Spark scores in rounds: a pattern is as good
for a kind as the share of its instances that are of that kind, an instance as good as the noisy-or of its patterns
(after Snowball: Agichtein & Gravano, 2000), until the scores settle. What high-confidence patterns hold and no base pattern covers is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, nested, written

#: The base patterns, written so that no start is tried twice: a run of a pattern's first characters is entered at its
#: beginning, or where the match before ended, and never given back.
KINDS = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9](?:[\\x20-]?[0-9])++",
    "phone": r"\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Whether a text can hold the kind at all, and whether a match m counts.
_MAY = {"email": "contains(text, '@')", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')"}
_VALID = {
    "email": "true",
    "ip": r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": "length(replace(replace(m, ' ', ''), '-', '')) between 14 and 19 and luhn_check(replace(replace(m, ' ', ''), '-', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 10 and 15",
}
#: Runs of tokens that hold a digit or an @.
_TOKEN = r"(?<!\\S)(?=[^\\s0-9@]*[0-9@])\\S++(?:\\x20(?=[^\\s0-9@]*[0-9@])\\S++)*+"
_BLOCK = 128
#: A trust that grows by no more than this in a round has settled.
_SETTLED = 1e-6


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring at least; support: distinct seeds or found values that a pattern needs; confidence: what patterns and instances need."""

    rounds: int = 3
    support: int = 3
    confidence: float = 0.7
    shortest: int = 5


def _in_blocks(z: str) -> str:
    """SQL: an array in slices of _BLOCK elements; an empty one is one empty slice."""
    return f"transform(sequence(0, (size({z}) - 1) div {_BLOCK}), k -> slice({z}, cast(k * {_BLOCK} + 1 as int), {_BLOCK}))"


def _placed(z: str) -> str:
    """SQL: from an array of (g: characters before, m: match, c: context) to (start, end, m, c). In blocks, so that long arrays are not copied for every element."""
    empty = "cast(array() as array<struct<start:int,end:int,m:string,c:string>>)"
    inner = (
        f"aggregate(b, named_struct('at', 0, 's', {empty}), (a, x) -> named_struct('at', a.at + x.g + length(x.m), 's', "
        "concat(a.s, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + length(x.m), 'm', x.m, 'c', x.c)))))"
    )
    blocks = f"transform({_in_blocks(z)}, b -> {inner})"
    outer = (
        f"aggregate({blocks}, named_struct('at', 0, 's', cast(array() as array<array<struct<start:int,end:int,m:string,c:string>>>)), (a, b) -> named_struct('at', a.at + b.at, 's', "
        "concat(a.s, array(transform(b.s, y -> named_struct('start', y.start + a.at, 'end', y.end + a.at, 'm', y.m, 'c', y.c))))), a -> flatten(a.s))"
    )
    return f"case when size({z}) > 0 then {outer} else {empty} end"


def _matches(pattern: str, context: bool = False) -> str:
    """SQL: the (g, m, c) of a pattern in text."""
    # two patterns, kept apart by a line break, which no word holds: the last two words before, and the last before with the first after; an empty one says nothing
    words = r"filter(split(lower(substring(gaps[i], -80)), '\\s+'), v -> v <> '')"
    after = r"get(filter(split(lower(substring(gaps[i + 1], 1, 80)), '\\s+'), v -> v <> ''), 0)"
    two = "case when size(w) = 0 then '' else array_join(slice(w, -least(2, size(w)), least(2, size(w))), ' ') end"
    beside = f"coalesce(concat(element_at(w, -1), ' _ ', {after}), '')"
    left = f"transform(array({words}), w -> concat({two}, '\\n', case when size(w) = 0 then '' else {beside} end))[0]" if context else "cast(null as string)"
    return f"transform(array(split(text, '{pattern}', -1)), gaps -> transform(regexp_extract_all(text, '{pattern}', 0), (m, i) -> named_struct('g', length(gaps[i]), 'm', m, 'c', {left})))[0]"


def _base(rows: DataFrame) -> DataFrame:
    """rows with `base`, the base spans (start, rank, end) in order."""
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        rows = rows.withColumn("z", F.expr(f"case when {_MAY[kind]} then {_matches(pattern)} end"))
        rows = rows.withColumn(kind, F.expr(f"case when z is null or size(z) = 0 then null else transform(filter({_placed('z')}, s -> transform(array(s.m), m -> {_VALID[kind]})[0]), s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end)) end"))
        found.append(f"coalesce({kind}, cast(array() as array<struct<start:int,rank:int,end:int>>))")
    return rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(found)}))")).drop("z", *KINDS)


def _candidates(rows: DataFrame, shortest: int) -> DataFrame:
    """rows with `found`, the candidates (start, end, value, pattern, rank): rank is that of the base span they touch, null if none."""
    rows = rows.withColumn("z", F.expr(f"case when contains(text, '@') or text rlike '[0-9]' then {_matches(_TOKEN, context=True)} end"))
    trimmed = (
        "transform(" + _placed("z") + r""", s -> named_struct(
            'start', s.start + length(regexp_extract(s.m, '^[\\p{Punct}&&[^+@]]*+', 0)),
            'value', regexp_replace(s.m, '^[\\p{Punct}&&[^+@]]++|[\\p{Punct}&&[^@]]++$', ''), 'pattern', s.c))"""
    )
    rows = rows.withColumn("t", F.expr(f"case when z is not null and size(z) > 0 then filter({trimmed}, s -> length(s.value) >= {shortest}) end")).drop("z")
    # both lists are in order, so a block of candidates is held against the blocks of base spans that reach into it, not against all of them
    rows = rows.withColumn("bb", F.expr(f"case when size(t) > 0 then transform({_in_blocks('base')}, x -> named_struct('low', get(x, 0).start, 'high', array_max(transform(x, b -> b.end)), 'x', x)) end"))
    touch = "get(filter(near, b -> b.start < s.start + length(s.value) and b.end > s.start), 0).rank"
    ranked = f"transform(k, s -> named_struct('start', s.start, 'end', s.start + length(s.value), 'value', lower(s.value), 'pattern', s.pattern, 'rank', {touch}))"
    near = "flatten(transform(filter(bb, q -> q.low < element_at(k, -1).start + length(element_at(k, -1).value) and q.high > get(k, 0).start), q -> q.x))"
    found = f"case when size(t) > 0 then flatten(transform({_in_blocks('t')}, k -> transform(array({near}), near -> {ranked})[0])) end"
    return rows.withColumn("found", F.expr(found)).drop("t", "bb")


def _learn(seen: DataFrame, p: Bootstrap) -> DataFrame:
    """(value, rank): the unseen instances that high-confidence patterns hold. seen: (pattern, value, rank or null).

    What a round finds is support for other patterns in the next. Masses, trusts and scores only grow from round to round, so the rounds
    end, and they go on until no pattern is new and no trust grows.
    Both sides of a join by value or pattern are plain tables, so that Spark can split a value or pattern that very many edges have.
    """
    edges = written(seen.filter("pattern <> ''").groupBy("pattern", "value").agg(F.max("rank").alias("seed")), "pii-edges")
    # a value that a base pattern covers anywhere is a seed of that kind
    seeds = written(edges.filter("seed is not null").groupBy("value").agg(F.max("seed").alias("rank")), "pii-seeds")
    known = edges.drop("seed").join(seeds, "value", "left")
    held = written(known, "pii-graph")
    # a pattern of fewer values than `support` can never have it
    sizes = written(held.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= p.support), "pii-sizes")
    seeded = written(held.filter("rank is not null").groupBy("pattern", "rank").agg(F.count("*").alias("mass")).select("pattern", "rank", F.col("mass").cast("double"), F.col("mass").alias("support")), "pii-support")
    unseen = written(held.filter("rank is null").select("pattern", "value").join(sizes.select("pattern"), "pattern", "left_semi"), "pii-unseen")
    mass, before, done = seeded, None, 0
    while True:
        scored = mass.filter(F.col("support") >= p.support).join(sizes, "pattern").withColumn("trust", F.col("mass") / (F.col("n") + 0.5))
        patterns = written(scored.filter(F.col("trust") >= p.confidence).select("pattern", "rank", "trust"), "pii-patterns")
        moved = patterns if before is None else patterns.join(before.withColumnRenamed("trust", "was"), ["pattern", "rank"], "left").filter(F.col("was").isNull() | (F.col("trust") - F.col("was") > _SETTLED))
        settled, done, before = moved.isEmpty(), done + 1, patterns
        if settled and (done >= p.rounds or patterns.isEmpty()):
            break
        fresh = unseen.join(patterns, "pattern").groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"))
        scores = written(fresh, "pii-scores")
        # what was found counts like a seed: by its score, and as support where that reaches the confidence
        found = unseen.join(scores, "value").groupBy("pattern", "rank").agg(F.sum("score").alias("mass"), F.sum((F.col("score") >= p.confidence).cast("long")).alias("support"))
        mass = seeded.unionByName(found).groupBy("pattern", "rank").agg(F.sum("mass").alias("mass"), F.sum("support").alias("support"))
    new = unseen.join(patterns, "pattern").groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score")).filter(F.col("score") >= p.confidence)
    return new.groupBy("value").agg(F.max_by("rank", F.struct("score", -F.col("rank"))).alias("rank"))


def personal_data(docs: DataFrame, parameters: Bootstrap | None = None) -> DataFrame:
    """Per row of docs: doc_id, h (hash of the text), base and spans, both arrays of (start, rank, end) in order; rank indexes KINDS.

    Offsets are code points, end exclusive. Null and empty texts have no spans; texts of any length are searched whole, in time about in proportion to
    it; repeated rows each give a row; null ids are kept; an empty table gives no rows. Only doc_id and text are looked at.
    """
    p = parameters or Bootstrap()
    rows = _candidates(_base(id_text(docs)), p.shortest).select("doc_id", F.xxhash64("text").alias("h"), "base", "found")
    held = written(rows, "pii-spans")
    every = held.filter("found is not null").select("doc_id", "h", F.explode("found").alias("f")).select("doc_id", "h", "f.*")
    new = _learn(every.select(F.explode(F.split("pattern", "\n")).alias("pattern"), "value", "rank"), p)
    added = every.filter("rank is null").drop("rank").join(new, "value").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "rank", "end")).alias("added"))
    both = held.select("doc_id", "h", "base").alias("b").join(added.alias("a"), F.col("b.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("b.h") == F.col("a.h")), "left")
    return both.select("b.doc_id", "b.h", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def named(spans: str) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({kinds})[s.rank], ':', s.start, ':', s.end)), ',')")


def counted(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.rank = {list(KINDS).index(kind)})) as bigint)")


def redacted(docs: DataFrame, parameters: Bootstrap | None = None) -> DataFrame:
    """docs with each span of personal_data in `text` replaced by its kind in brackets; of spans that overlap the first counts, and what a later one covers beyond it gets the later kind.

    Null texts stay null, empty ones and those without spans stay as they are; repeated rows, null ids, an empty table and very long texts as in personal_data. All
    columns are kept, whatever they are called.
    """
    spans = personal_data(docs, parameters).filter("size(spans) > 0").select(F.col("doc_id").alias("span_id"), F.col("h").alias("span_h"), "spans").dropDuplicates(["span_id", "span_h"])
    both = nested(docs).join(spans, F.col("row_id").eqNullSafe(F.col("span_id")) & (F.col("row_hash") == F.col("span_h")), "left")
    # blocks of spans without overlaps; at: where the last one ended. Text is cut block by block, so that a long one is not searched from its beginning for every span
    span = "array<struct<start:int,rank:int,end:int>>"
    inner = f"aggregate(b, named_struct('at', a.at, 's', cast(array() as {span})), (c, s) -> case when s.end <= c.at then c else named_struct('at', s.end, 's', concat(c.s, array(named_struct('start', greatest(s.start, c.at), 'rank', s.rank, 'end', s.end)))) end)"
    apart = f"aggregate({_in_blocks('spans')}, named_struct('at', 0, 's', cast(array() as array<{span}>)), (a, b) -> transform(array({inner}), r -> named_struct('at', r.at, 's', concat(a.s, array(r.s))))[0], a -> filter(a.s, b -> size(b) > 0))"
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    before = "coalesce(element_at(get(cut, i - 1), -1).end, 0)"
    inside = f"transform(b, (s, j) -> concat(substring(p.text, coalesce(get(b, j - 1).end, p.at) - p.at + 1, s.start - coalesce(get(b, j - 1).end, p.at)), array({kinds})[s.rank]))"
    block = f"transform(array(named_struct('at', {before}, 'text', substring(row_text, {before} + 1, element_at(b, -1).end - {before}))), p -> array_join({inside}, ''))[0]"
    both = both.withColumn("cut", F.expr(f"case when spans is not null then {apart} end"))
    replaced = f"concat(array_join(transform(cut, (b, i) -> {block}), ''), substring(row_text, element_at(element_at(cut, -1), -1).end + 1))"
    text = F.when(F.col("cut").isNull(), F.col("row")["text"]).otherwise(F.expr(replaced))
    return both.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
