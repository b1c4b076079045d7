import os
import random
import threading
import tomllib
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import ClassVar

import pytest
from pyspark.sql import functions as F

from loomspace.config import Ingest, Scoring, Settings
from loomspace.operators import chunking, enrichment, placement, scoring, sharding
from loomspace.plans import pipeline
from loomspace.sources import files, models, shared, store
from loomspace.streaming import ingest

WORDS = "orbital mechanics describes rockets while hyperbolic geometry describes manifolds and market mania describes crowds".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(WORDS[k % 5 :] + WORDS[: k % 7] + [f"filler{k}"]) for k in range(24)]
    return spark.createDataFrame([(k, f"s{k % 2}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('build')}"
    pipeline.build(docs, Settings(output_dir=path, ingest=Ingest(60, 10), scoring=Scoring(min_occurrences=3)), dimension=16)
    return path


def test_build_and_retrieve(spark, built):
    rows = store.read_shards(spark, f"{built}/concepts")
    assert rows.count() > 5 and "v" not in rows.columns and rows.filter("label = ''").count() == 0
    registry, seed, dimension = store.read_registry(spark, f"{built}/registry")
    assert (seed, dimension) == (42, 16) and registry.next_id == len(registry.numbers)
    some = rows.orderBy("raw_term").first()
    at = [0.999 * x for x in some.pos]
    exact = pipeline.retrieve_exact(spark, built, at, 0.9).collect()
    assert some.raw_term in {r.raw_term for r in exact}
    prompt = pipeline.answer_prompt(pipeline.retrieve(spark, built, at), "Why?").first().prompt
    assert prompt.endswith("QUESTION: Why?\n\nANSWER:") and prompt.count("\n- ") == 5
    assert store.read_shards(spark, f"{built}/concepts", ["shard-0", "no such shard"]).select("shard_id").distinct().count() <= 1


def test_toml_export(spark, built):
    found = tomllib.loads(store.toml_shards(store.read_shards(spark, f"{built}/concepts")).first().toml)
    concept = next(iter(found["concepts"].values()))
    assert len(concept["coordinate"]["Hyperbolic"]["position"]) == 3 and concept["source_line"] == 1
    assert "source_line" not in store.shard_toml("shard-1", [{"raw_term": 'a"b', "label": "", "description": None, "strength": 1, "source": "s", "source_line": None, "local_pos": [0, 0, 0], **dict.fromkeys(("gromov_delta", "eigenvalue_ratio", "first_dominance", "neg_eigenvalue_fraction"), 0.0)}])


def test_shards_are_split_and_read_alone(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.range(3000).selectExpr("id as ord", "concat('t', id div 2) as raw_term", "if(id < 2900, 'shard-0', concat('shard-', id)) as shard_id", "repeat('x', 50) as text")
    before, store.FILE_ROWS = store.FILE_ROWS, 500
    try:
        store.write_concepts(rows, path)
    finally:
        store.FILE_ROWS = before
    assert len(list((tmp_path / "store" / "shard_id=shard-0").glob("*.parquet"))) >= 3  # 1450 rows are left of 2900
    some = store.read_shards(spark, path, ["shard-2950", "shard-0", "no such shard", "shard-0"])
    assert len({f.rsplit("/", 2)[1] for f in some.inputFiles()}) == 2
    assert {r.shard_id: r["count"] for r in some.groupBy("shard_id").count().collect()} == {"shard-0": 1450, "shard-2950": 1}
    assert some.filter("ord % 2 = 0 and shard_id = 'shard-0'").count() == 0  # the later of two equal terms stays
    assert store.read_shards(spark, path, ["none"]).count() == 0 and {r.kind for r in some.select("kind").collect()} == {"hyperbolic"}


def test_build_computes_neighbours_once_and_cleans_up(spark, docs, tmp_path, monkeypatch):
    calls, stages = [], []
    whole = placement.knn
    monkeypatch.setattr(placement, "knn", lambda *a: calls.append(1) or whole(*a))
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    pipeline.build(docs, Settings(output_dir=f"file://{tmp_path}/out", ingest=Ingest(60, 10), scoring=Scoring(min_occurrences=3)), report=lambda *a: stages.append(a))
    assert len(calls) == 1 and [s[0] for s in stages] == ["chunks, terms and scores", "embeddings", "placement and routing", "enrichment and storage"]
    assert stages[0][2] > 0 and set(os.listdir(folder)) == before


def test_sources_are_routed_in_the_order_of_their_list(spark):
    docs = spark.createDataFrame([("b", 0), ("a", 1), ("b", 0)], "source string, source_ord int")
    assert {r.source: r.source_no for r in pipeline.source_numbers(docs).collect()} == {"b": 0, "a": 1}
    assert {r.source: r.source_no for r in pipeline.source_numbers(docs.drop("source_ord")).collect()} == {"a": 1, "b": 2}


def test_dry_run(spark, docs):
    assert pipeline.dry_run(docs, Settings(scoring=Scoring(min_occurrences=3))).count() == 12


def test_terms_without_vectors_are_left_out(spark, docs):
    s = Settings(ingest=Ingest(60, 10), scoring=Scoring(min_occurrences=3))
    terms = pipeline.scored_terms(docs, s)
    some = terms.select("term").distinct().orderBy("term").limit(3).withColumn("v", models.hashed_embedding(F.col("term"), 8))
    placed, _ = pipeline.placed_terms(terms, some, s, 8)
    assert placed.select("raw_term").distinct().count() == 3


def test_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = files.read_texts(spark, [f"file://{tmp_path}/a.txt"]).collect()
    assert [(r.text, r.source_ord, r.doc_id) for r in rows] == [("one\ntwo", 0, 0)]
    with pytest.raises(Exception, match="UTF-8"):
        files.read_texts(spark, [f"file://{tmp_path}/b.txt"]).collect()
    assert not shared.exists(spark, f"file://{tmp_path}/none.txt") and shared.exists(spark, f"file://{tmp_path}/a.txt")


def test_clients():
    sent = []
    embed = models.HttpEmbedder("http://h", "m", lambda url, body: sent.append((url, body)) or b'{"embeddings":[[0.1,-0.2,0.3]]}')
    assert embed("x") == [0.1, -0.2, 0.3] and sent[0][0] == "http://h/api/embed" and b'"input": "x"' in sent[0][1]
    with pytest.raises(ValueError):
        models.HttpEmbedder.first(b'{"embeddings":[]}')
    class Server(BaseHTTPRequestHandler):
        answers: ClassVar[list] = [503, 200, 404]

        def do_POST(self):
            self.send_response(Server.answers.pop(0))
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *_):
            pass

    with HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}"
        assert models.post(url, b"{}", timeout=5, tries=2) == b"{}"
        with pytest.raises(OSError, match="404"):
            models.post(url, b"{}", timeout=5)
        server.shutdown()
    assert Server.answers == []
    chat = models.HttpGenerator("http://h", "m", lambda url, body: b'{"message":{"role":"assistant","content":"hi"}}' if b'"stream": false' in body else b"")
    assert chat("p") == "hi"


def test_prompts_and_signal(spark):
    made = spark.range(1).select(enrichment.summary_prompt(F.lit("tulip"), F.lit("text")).alias("a"), enrichment.name_prompt(F.lit("d")).alias("b")).first()
    assert made.a.count("tulip") == 4 and "do not interpret, infer, or add outside knowledge" in made.a and "Description: d" in made.b
    cut = spark.createDataFrame([("s", 1, 0, "Alpha beta"), ("s", 2, 0, "beta"), ("t", 3, 0, "alpha")], "source string, doc_id long, start int, text string")
    strong = spark.createDataFrame([("s", "alpha", 0.9), ("s", "beta", 0.6)], "source string, term string, strength double")
    assert {r.doc_id: round(r.signal, 6) for r in enrichment.chunk_signal(cut, strong).collect()} == {1: 1.5, 2: 0.6, 3: 0.0}


def test_stream_continues_the_registry(spark, tmp_path):
    rows = [(k, [0.0, 0.0, 0.0] if k % 2 else [0.9, 0.01 * k, 0.0]) for k in range(8)]
    placed = spark.createDataFrame(rows, "ord long, pos array<double>")
    placed.filter("ord < 4").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    placed.filter("ord >= 4").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(placed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.route_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/concepts")
    whole = sharding.assign(placed, sharding.find_anchors(placed, 0.9), 0.9)
    assert {(r.ord, r.shard_id) for r in found.collect()} == {(r.ord, r.shard_id) for r in whole.collect()}


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (10, 8), (5, 0), (7, 6), (2000, 200)])
def test_chunks_against_slices(spark, size, overlap):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice("ab é日😀\n\r\x85") for _ in range(n)) for n in (0, 1, 2, size, size + 1, 333, 5000)] + [None]
    stride = size - overlap
    wanted = {(k, s, t[s : s + size], 1 + t[:s].count("\n")) for k, t in enumerate(texts) for s in range(0, len(t or ""), stride)}
    cut = chunking.chunks(spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string"), Ingest(size, overlap))
    assert {(r.doc_id, r.start, r.text, r.source_line) for r in cut.collect()} == wanted


def test_term_chunks_is_signal_and_membership(spark, docs):
    """One pass gives what chunk_signal and the terms of each chunk give apart."""
    cut = chunking.chunks(docs, Ingest(60, 10))
    kept = spark.createDataFrame([("s0", "rockets", 0.9), ("s0", "market mania", 0.6), ("s1", "manifolds", 0.4)], "source string, term string, strength double")
    strong = kept.filter("strength > 0.5")
    signal = {(r.source, r.doc_id, r.start): r.signal for r in enrichment.chunk_signal(cut, strong).collect()}
    holds = {}
    for r in scoring.chunk_terms(cut).join(kept, ["source", "term"]).collect():
        holds.setdefault((r.source, r.term), []).append((-round(signal[r.source, r.doc_id, r.start], 9), r.doc_id, r.start))
    wanted = {(*key, k + 1, d, s) for key, rows in holds.items() for k, (_, d, s) in enumerate(sorted(rows)[:5])}
    assert {(r.source, r.term, r["rank"], r.doc_id, r.start) for r in enrichment.term_chunks(cut, strong, kept).collect()} == wanted != set()
