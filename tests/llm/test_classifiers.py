import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.llm import quality_cnn as Q
from loomspace.llm import toxicity as T
from loomspace.llm.common import labelled_sample


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    rows = []
    for k in range(n):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 150))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            ws = [w + rnd.choice(["%%%", "***", "&&&"]) for w in ws]
        if toxic:
            for w in rnd.sample(["vileword", "nastyword", "foulword"], 2):
                ws.insert(rnd.randint(0, len(ws)), w)
        rows.append((k, " ".join(ws), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(600, 3)
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    found = {r.doc_id: r for r in Q.quality_scores(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([found[r[0]].predicted == r[2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    found = {r.doc_id: r for r in T.toxicity(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    assert np.mean([found[r[0]].predicted == r[3] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_sample_holds_training_rows_only(tables):
    docs, labels, rows = tables
    some = [tuple(r) for r in labelled_sample(docs, labels, "quality", F.col("doc_id") % 3 != 0, 50, 10_000, "s").collect()]
    allowed = {r[1] for r in rows if r[0] % 3}
    assert len(some) == 100 and {y for _, y in some} == {0, 1} and all(t in allowed for t, _ in some)
    again = labelled_sample(docs.repartition(7), labels, "quality", F.col("doc_id") % 3 != 0, 50, 10_000, "s")
    assert some == [tuple(r) for r in again.collect()]
    assert [(a.tolist(), y) for a, y in T.hashed_rows(again)] == [(T.Hasher().features(t).tolist(), y) for t, y in some]


def test_convolution_against_loops():
    model = Q.Cnn.fresh(1, 0.6)
    text = bytes(random.Random(1).randrange(256) for _ in range(1301))
    padded = text + b"\0"
    chunks = []
    for begin in range(0, max(1, len(padded) - 64), 448):
        piece = padded[begin : begin + 512]
        values = [np.concatenate([model.embed[b] for b in piece[k : k + 8]]) @ model.conv + model.conv_bias for k in range(0, len(piece) - 7, 2)]
        chunks.append(np.maximum(np.max(values, axis=0), 0))
    length = Q.filled([text])[0]
    wanted = Q.head(model, np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0), length))[None])[0][0]
    assert Q.scores(model, [text])[0] == pytest.approx(wanted, abs=1e-5)


def test_a_long_text_scores_alike_in_pieces(monkeypatch):
    model = Q.Cnn.fresh(2, 0.5)
    text = bytes(random.Random(2).randrange(32, 127) for _ in range(70_001))
    whole = Q.scores(model, [text, b"", b"short"])
    monkeypatch.setattr(Q, "BLOCK", 4096)
    assert np.allclose(whole, Q.scores(model, [text, b"", b"short"]), atol=1e-5)


def test_gradients_against_differences():
    model = Q.Cnn.fresh(3, 0.5)
    for p in model.parts():
        p[...] = p.astype(np.float32)
    texts, y, w = [b"hello world, this is a text", b"%%% *** &&& !!!" * 9], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        s = np.clip(Q.scores(model, texts).astype(float), 1e-9, 1 - 1e-9)
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    for p, g in zip(model.parts(), Q._gradients(model, texts, y, w), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_odd_rows(odd_docs, empty_docs, odd_rows, labels):
    for operator in (Q.quality_scores, T.toxicity):
        found = operator(odd_docs, labels, F.lit(True)).collect()
        assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in odd_rows)
        assert all(0 <= r.score <= 1 for r in found)
        same = {r.doc_id: r.score for r in found}
        assert same[8] == same[33]  # equal texts
        assert operator(empty_docs, labels, F.lit(True)).count() == 0
        assert operator(odd_docs, labels.filter("false"), F.lit(True)).count() == len(odd_rows)


def test_weights_are_sparse():
    hasher = T.Hasher()
    model = T.fit([(hasher.features(t), y) for _, t, _, y in corpus(400, 1)])
    assert 0 < len(model.at) < 2000 and len(model.at) == np.count_nonzero(model.dense())


def brute_features(text, bits):
    """Hashed words, neighbours, and pairs with one word between, one by one in whole numbers."""
    ws, out = re.findall(r"[^\W_]+", text.lower()), set()
    h = [zlib.crc32(w.encode()) + 1 for w in ws]
    low = (1 << 64) - 1
    for k, x in enumerate(h):
        found = [x]
        if k + 1 < len(h):
            found.append(((x * 0x100000001B3) & low) ^ h[k + 1] ^ (1 << 40))
        if k + 2 < len(h):
            found.append(((x * 0x1000193) & low) ^ h[k + 2] ^ (1 << 41))
        out |= {((v * 0x9E3779B97F4A7C15) & low) >> (64 - bits) for v in found}
    return sorted(out)


def brute_ftrl(rows, p):
    """The published per-coordinate algorithm, coordinate by coordinate, with the bias as it is learnt here."""
    z, n = {}, {}
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    bias, bias_n = math.log(share / (1 - share)), 0.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= p.l1 else -(v - math.copysign(p.l1, v)) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = np.random.default_rng(5)
    for _ in range(p.passes):
        for k in order.permutation(len(rows)).tolist():
            at, y = rows[k]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + math.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


@pytest.mark.parametrize("p", [T.Ftrl(), T.Ftrl(alpha=0.3, beta=0.5, l1=1.0, l2=0.2, passes=3)])
def test_ftrl_against_brute_force(p):
    hasher, texts = T.Hasher(14), [(t, y) for _, t, _, y in corpus(120, 9)]
    rows = [(hasher.features(t), y) for t, y in texts]
    assert [a.tolist() for a, _ in rows] == [brute_features(t, 14) for t, _ in texts]
    model = T.fit(rows, 14, p)
    wanted, bias = brute_ftrl([(a.tolist(), y) for a, y in rows], p)
    assert dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(wanted, abs=1e-9) and model.bias == pytest.approx(bias)
