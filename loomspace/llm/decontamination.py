"""Benchmark decontamination through a positional inverted index with next-word lists, in DataFrame operations alone.

The index stores a posting (pair, document, position) for each place of the corpus where a word and its successor form a pair
that a benchmark item holds, and each document's length (next-word indexes: Williams, Zobel & Bahle, 2004). It is made for the given
benchmark: pairs that no item holds are not stored, so another benchmark needs another index.

A phrase is found from its rarest pair: that pair's postings, shifted by its offset, say where an item could start; the next rarest
pair's postings at the offset they then need cut these down, and the survivors are held against the postings of all pairs of
the item. Runs of consecutive pairs are exact phrases. Proximity matches come from the same shifted lists: the rarest pairs of an item,
so many that a match must have two of them, say around which starts it could lie, and only there all its pairs are counted. Only postings of the
rarest pairs are ever read as candidates, so frequent pairs cost nothing but their storage.

What the benchmark alone determines is broadcast if its counted rows are few, else joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import nested, written

WINDOW = 10
#: Rows of a table of benchmark pairs up to which it is broadcast, and 64-bit keys of pairs that are broadcast at once beyond that.
BROADCAST_ROWS = 200_000
BROADCAST_KEYS = 1 << 21
#: Proximity: words that a pair may stand off its place, and the share of an item's pairs that have to stand there.
SLACK, SHARE = 3, 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in lower-cased text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["doc_id", "h"]


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _cut(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, `n` (how many words) and `parts`: the words in order, with an empty part first or last where the text begins or ends between words."""
    parts = docs.select(*keep, F.split(lowered(F.col("text")), _BETWEEN).alias("parts"))
    size, last = F.size("parts"), F.element_at("parts", -1)
    edges = (F.element_at("parts", 1) == "").cast("int") + ((size > 1) & (last == "")).cast("int")
    return parts.select(*keep, (size - edges).alias("n"), "parts")


def _pairs(cut: DataFrame, keep: list[str]) -> DataFrame:
    """A row per part: keep, pos, word and next (null for the last part)."""
    zipped = F.arrays_zip(F.col("parts").alias("word"), F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))).alias("next"))
    return cut.select(*keep, F.posexplode(zipped).alias("pos", "p")).select(*keep, "pos", F.col("p.word").alias("word"), F.col("p.next").alias("next"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """A row per part of each item: item (its id), version (of its text), m (words), off, word, next. Items without words have none."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.xxhash64("text").alias("version"), "text").distinct()
    cut = _cut(items, ["item", "version"]).filter("n > 0").withColumn("skip", (F.element_at("parts", 1) == "").cast("int"))
    rows = _pairs(cut, ["item", "version", "n", "skip"])
    return rows.filter("word <> ''").select("item", "version", F.col("n").alias("m"), (F.col("pos") - F.col("skip")).alias("off"), "word", F.when(F.col("next") != "", F.col("next")).alias("next"))


def _postings(found: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """found with `pair`, for rows whose (word, next) is one of pairs; others stay only if they are the last of their document (next is null), without pair.

    Very many pairs go in two steps: slices of their keys are broadcast one after the other, so that words of no item never travel, and what
    passes is then held against the words by a shuffle.
    """
    same = (F.col("key") == F.col("pair")) & (F.col("word") == F.col("w1")) & (F.col("next") == F.col("w2"))
    if n_pairs <= BROADCAST_ROWS:
        return found.join(F.broadcast(pairs), same, "left").filter("w1 is not null or next is null")
    slices = -(-n_pairs // BROADCAST_KEYS)
    keys = pairs.select("pair").distinct()
    passed = found.filter("next is null").withColumn("key", F.lit(None).cast("bigint"))
    for k in range(slices):
        here = found.filter((F.pmod("key", F.lit(slices)) == k) & F.col("next").isNotNull())
        passed = passed.union(here.join(F.broadcast(keys.filter(F.pmod("pair", F.lit(slices)) == k)), F.col("key") == F.col("pair"), "left_semi"))
    return passed.join(pairs, same, "left").filter("w1 is not null or next is null")


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stored index: rows (doc_id, h, pair, pos) for pairs of the benchmark, (doc_id, h, word, pos) for words of one-word
    items, and (doc_id, h, n_words) per document row. h tells rows of one doc_id with different texts apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = _cut(rows.withColumn("h", F.xxhash64("text")), [*_DOC, "text"])
    found = _pairs(cut, [*_DOC, "n"]).withColumn("key", F.xxhash64("word", "next"))
    pairs = items.filter("next is not null").select("word", "next").distinct().select(F.xxhash64("word", "next").alias("pair"), F.col("word").alias("w1"), F.col("next").alias("w2"))
    singles = items.filter("m = 1").select(F.col("word").alias("single")).distinct()
    n_pairs, n_singles = pairs.count(), singles.count()
    length = F.when(F.col("next").isNull(), F.col("n").cast("long")).alias("n_words")
    known = _postings(found, pairs, n_pairs).select(*_DOC, length, "pair", "pos", F.lit(None).cast("string").alias("word"))
    if n_singles:
        none = F.lit(None).cast("bigint")
        alone = found.join(few(singles, n_singles), F.col("word") == F.col("single")).select(*_DOC, none.alias("n_words"), none.alias("pair"), "pos", "word")
        known = known.union(alone)
    return written(known, "postings")


def _seeds(items: DataFrame, index: DataFrame) -> DataFrame:
    """The windows all of whose pairs the corpus has: item, version, start, pairs, and the offsets and pairs of the rarest and next rarest one."""
    counted = index.filter("pair is not null").groupBy("pair").count()
    pairs = items.filter("next is not null").select("item", "version", "m", "off", F.xxhash64("word", "next").alias("pair")).join(counted, "pair")
    length = F.least(F.lit(WINDOW), F.col("m")) - 1
    starts = F.explode(F.sequence(F.greatest(F.col("off") - length + 1, F.lit(0)), F.least(F.col("off"), F.col("m") - 1 - length)))
    windows = pairs.select("item", "version", "off", "pair", "count", length.alias("pairs"), starts.alias("start")).groupBy("item", "version", "start", "pairs")
    ranked = windows.agg(F.count("*").alias("there"), F.sort_array(F.collect_list(F.struct("count", "off", "pair"))).alias("r")).filter("there = pairs")
    one, two = F.element_at("r", 1), F.element_at("r", F.least(F.lit(2), F.size("r")))
    return ranked.select("item", "version", "start", "pairs", one["off"].alias("off"), one["pair"].alias("pair"), two["off"].alias("off2"), two["pair"].alias("pair2"))


def _runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive off per keys: begin, end."""
    order = Window.partitionBy(*keys).orderBy("off")
    islands = rows.withColumn("island", F.col("off") - F.dense_rank().over(order))
    return islands.groupBy(*keys, "island").agg(F.min("off").alias("begin"), F.max("off").alias("end"))


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """Where windows of items occur: doc_id, h, item, first and last word position of each maximal run of windows."""
    seeds = written(_seeds(items, index), "seeds")
    n_seeds = seeds.count()
    postings = index.filter("pair is not null").select(*_DOC, "pair", "pos")
    # candidates: where the item would start by its window's rarest pair, if the next rarest is where it has to be
    first = postings.join(few(seeds.select("item", "version", "off", "pair", "off2", "pair2").distinct(), n_seeds), "pair")
    first = first.select(*_DOC, "item", "version", (F.col("pos") - F.col("off")).alias("at"), "pair2", (F.col("pos") - F.col("off") + F.col("off2")).alias("pos2")).distinct()
    second = postings.join(few(seeds.select(F.col("pair2").alias("pair")).distinct(), n_seeds), "pair", "left_semi")
    a, b = first.alias("a"), second.distinct().alias("b")
    met = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.pair2") == F.col("b.pair")) & (F.col("a.pos2") == F.col("b.pos")), "left_semi")
    candidates = met.select(*_DOC, "item", "version", "at").distinct()
    # all pairs of the item, at the positions the candidate asks for
    pairs = items.filter("next is not null").select("item", "version", "m", "off", F.xxhash64("word", "next").alias("pair"))
    wanted = candidates.join(few(pairs, pairs.count()), ["item", "version"]).select(*_DOC, "item", "version", "at", "m", "off", F.col("pair").alias("want"), (F.col("at") + F.col("off")).alias("where")).alias("w")
    p = postings.alias("p")
    hit = wanted.join(p, F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.want") == F.col("p.pair")) & (F.col("w.where") == F.col("p.pos")), "left_semi")
    runs = _runs(hit.select(*_DOC, "item", "version", "at", "m", "off"), [*_DOC, "item", "version", "at", "m"])
    long_enough = runs.filter(F.col("end") - F.col("begin") + 2 >= F.least(F.lit(WINDOW), F.col("m")))
    found = long_enough.select(*_DOC, "item", (F.col("at") + F.col("begin")).alias("first"), (F.col("at") + F.col("end") + 1).alias("last"))
    single = items.filter("m = 1").select("item", "word").distinct()
    n_single = single.count()
    if not n_single:
        return found
    alone = index.filter("word is not null").join(few(single, n_single), "word").select(*_DOC, "item", F.col("pos").alias("first"), F.col("pos").alias("last"))
    return found.union(alone)


def proximity_matches(index: DataFrame, items: DataFrame, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Near phrases: doc_id, h, item, start, n_pairs of the best alignment of each item that matches in a document.

    An alignment puts the item's first word at a start, any integer, before the document's first word too. It matches if of the item's pairs of neighbouring words at
    least `share` (one at least) stand in the document within `slack` words of their places. The best has most such pairs, then the least start.
    Items of one word have no pairs and no such matches.

    A match has need of an item's pairs, so of its `pairs - need + 2` rarest it has two at least (all of them if they are fewer), whose shifted positions
    lie within 2 * slack of one another. Windows of starts without two such pairs are out; in the others all pairs are counted.
    """
    postings = index.filter("pair is not null").select(*_DOC, "pair", "pos")  # repeated rows repeat them, which counts of distinct places do not see
    counted = postings.groupBy("pair").count()
    held = items.filter("next is not null").select("item", "version", "m", "off", F.xxhash64("word", "next").alias("pair"))
    need = F.greatest(F.lit(1), F.ceil((F.col("m") - 1) * share)).cast("int")
    order = Window.partitionBy("item", "version").orderBy(F.coalesce("count", F.lit(0)), "off")
    ranked = held.join(counted, "pair", "left").withColumn("need", need).withColumn("rarity", F.row_number().over(order))
    ranked = written(ranked.select("item", "version", "m", "off", "pair", "need", "rarity", F.col("count").isNotNull().alias("there")), "near-pairs")
    n_pairs = ranked.count()
    # an item with too few pairs in the corpus at all cannot match
    able = ranked.groupBy("item", "version").agg(F.count_if("there").alias("n_there"), F.first("need").alias("least")).filter("n_there >= least").select("item", "version")
    ranked = ranked.join(few(able, n_pairs), ["item", "version"], "left_semi")
    seeds = ranked.filter("rarity <= m - 1 - need + 2 and there").select("item", "version", "off", "pair", "need")
    half = max(8, 2 * slack)  # windows of 2 * half starts overlap by half, so that what lies within 2 * slack lies in one of them
    window = F.explode(F.array(F.floor(F.col("start") / half), F.floor(F.col("start") / half) - 1)).alias("window")
    shifted = postings.join(few(seeds, n_pairs), "pair").select(*_DOC, "item", "version", "need", "off", (F.col("pos") - F.col("off")).alias("start"))
    met = shifted.select(*_DOC, "item", "version", "need", "off", window).groupBy(*_DOC, "item", "version", "need", "window").agg(F.min("off").alias("low"), F.max("off").alias("high"))
    # an item of which one pair suffices needs no second one
    places = written(met.filter("low < high or need = 1").select(*_DOC, "item", "version", "need", "window"), "near-places")
    wanted = places.join(few(ranked.filter("there").select("item", "version", "off", "pair"), n_pairs), ["item", "version"]).alias("w")
    p = postings.alias("p")
    inside = (F.col("p.pos") - F.col("w.off")).between(F.col("w.window") * half, (F.col("w.window") + 2) * half - 1)
    near = wanted.join(p, F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.pair") == F.col("p.pair")) & inside)
    at = F.explode(F.sequence(F.col("p.pos") - F.col("w.off") - slack, F.col("p.pos") - F.col("w.off") + slack)).alias("start")
    votes = near.select("w.doc_id", "w.h", "w.item", "w.version", "w.need", "w.off", at).distinct()
    counts = votes.groupBy(*_DOC, "item", "version", "need", "start").agg(F.count("*").alias("n_pairs")).filter("n_pairs >= need")
    best = counts.groupBy(*_DOC, "item").agg(F.max(F.struct("n_pairs", (-F.col("start")).alias("left"))).alias("b"))
    return best.select(*_DOC, "item", (-F.col("b.left")).alias("start"), F.col("b.n_pairs").alias("n_pairs"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any window of the benchmark, all columns kept, whatever they are called. Other cases as in contamination; proximity matches stay."""
    items = written(item_words(benchmark), "items")
    hit = phrase_matches(build_index(docs, items), items).select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct()
    rows = nested(docs).drop("row_text")
    return rows.join(written(hit, "hits"), F.col("row_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_h")), "left_anti").select("row.*")


def _digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256, h.

    n_near and near_sha256 are of the items with proximity matches, in the form of n_items and items_sha256; they do not make a document contaminated.
    Null and empty texts have no words; texts of any length are indexed whole. Repeated rows each give a row, rows of one doc_id with different texts are looked at
    separately, null ids are kept. Benchmark rows with a null id or text, or without words, are no items; rows that share an id are
    one item with the windows, and the proximity matches, of all their texts. Either table may be empty. Other columns are not looked at.
    """
    items = written(item_words(benchmark), "items")
    index = build_index(docs, items)
    matches = written(phrase_matches(index, items), "matches")
    listed = lambda rows: rows.groupBy(*_DOC).agg(F.sort_array(F.collect_set("item")).alias("items"))
    words = matches.select(*_DOC, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*_DOC).agg(F.count("*").alias("n_hit"))
    lengths = index.filter("n_words is not null").groupBy(*_DOC).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    kinds = {"n_words": "bigint", "copies": "bigint", "n_hit": "bigint", "exact": "array<string>", "near": "array<string>"}
    full = lambda rows: rows.select(*_DOC, *(F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    parts = full(lengths).union(full(words)).union(full(listed(matches).withColumnRenamed("items", "exact"))).union(full(listed(proximity_matches(index, items)).withColumnRenamed("items", "near")))
    none = F.array().cast("array<string>")
    rows = parts.groupBy(*_DOC).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_words", "copies", "n_hit")), *(F.coalesce(F.first(c, ignorenulls=True), none).alias(c) for c in ("exact", "near")))
    size = lambda c: F.size(c).cast("long")
    out = rows.select(
        "doc_id", "n_words", "n_hit", size("exact").alias("n_items"), _digest(F.col("exact")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        size("near").alias("n_near"), _digest(F.col("near")).alias("near_sha256"), "h", "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
