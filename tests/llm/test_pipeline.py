"""The stages against what the operators' own definitions give, row by row."""

import os

import pytest

import corpus_pipeline
from loomspace.llm import decontamination, pii, quality_rules, simhash_dedup
from loomspace.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(now := spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(steps[0]) == ids(quality_rules.quality_rules(docs).filter("kept"))
    groups: dict[int, set] = {}
    for r in simhash_dedup.simhash_components(steps[0]).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert ids(steps[1]) == set(groups)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(steps[2]) == ids(decontamination.contamination(steps[1], bench).filter("not contaminated"))
    assert ids(steps[3]) == ids(steps[2])
    spans = {r.doc_id: r.spans for r in pii.personal_data(steps[2]).collect()}
    before = {r.doc_id: r.text for r in steps[2].collect()}
    kinds = [f"[{k.upper()}]" for k in pii.KINDS]
    after = {}
    for i, text in before.items():
        out, at = "", 0
        for s in spans[i]:  # of what overlaps, the rest of the later one goes by its own kind
            if s.end > at:
                out, at = out + text[at : max(at, s.start)] + kinds[s["rank"]], s.end
        after[i] = out + text[at:]
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[3].collect()} == {i: (t, len(t)) for i, t in after.items()}
    library = Tokenizer.from_file(tokenizer)
    assert {r.doc_id: list(r.ids) for r in steps[4].collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in after.items()}
    assert corpus_pipeline.run(spark, SF).count() == steps[4].count()


def folders(path):
    return {f for f in os.listdir(path) if not f.startswith("_")} if os.path.isdir(path) else set()


@pytest.mark.parametrize("case", ["odd", "empty", "no benchmark"])
def test_odd_tables_end_to_end(spark, tokenizer, odd_docs, empty_docs, tmp_path, case):
    """Null, empty and very long texts, null and equal ids, repeated rows, clashing names, empty tables: all stages, none crashes, nothing is left behind."""
    docs = empty_docs if case == "empty" else odd_docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [] if case == "no benchmark" else [(1, "solo words that no document holds at all"), (2, None), (None, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    before = folders(shared)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    rows = found.collect()
    assert {f.split("-")[0] for f in folders(shared) - before} == {"corpus"} and len(folders(shared) - before) == 1
    if case == "empty":
        assert rows == []
        return
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
    assert len(rows) == now.count() > 5 and now.filter("text is null").isEmpty()
    assert now.filter("n_chars <> char_length(text)").isEmpty()


def test_filters_keep_nulls_and_clashing_columns(spark, odd_docs, empty_docs):
    """The filtering stages on tables whose columns have the operators' own names, with and without a benchmark."""
    bench = spark.createDataFrame([(1, "an item of the benchmark that no document has")], "item_id long, text string")
    for items in (bench, bench.filter("false")):
        kept = decontamination.decontaminated(odd_docs, items)
        assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
        assert decontamination.decontaminated(empty_docs, items).count() == 0
    one = simhash_dedup.simhash_filter(odd_docs)
    prints = {int(r.fingerprint, 16) for r in simhash_dedup.simhash_components(odd_docs).collect()}
    groups = 0  # by fingerprints, as two groups may have the same least id here
    while prints:
        groups, now = groups + 1, [prints.pop()]
        while now:
            near = {p for p in prints if (p ^ now[-1]).bit_count() <= simhash_dedup.RADIUS}
            now.pop()
            now += near
            prints -= near
    assert one.columns == odd_docs.columns and one.count() == groups
    assert simhash_dedup.simhash_filter(empty_docs).count() == 0
