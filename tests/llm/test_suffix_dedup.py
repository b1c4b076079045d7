import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspace.llm import cover_sort as V
from loomspace.llm import suffix_dedup as S


def slow(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


def test_cover():
    assert {(a - b) % V.V for a in V.COVER for b in V.COVER} == set(range(V.V))
    for i in range(V.V):
        for j in range(V.V):
            assert (i + V.SHIFT[i, j]) % V.V in V.COVER and (j + V.SHIFT[i, j]) % V.V in V.COVER


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 3]), st.integers(1, 6))
def test_suffix_order_and_classes(seed, letters, copies):
    rnd = random.Random(seed)
    part = "".join(rnd.choice("abc"[:letters]) for _ in range(rnd.randint(200, 420)))
    text = "".join(part[rnd.randint(0, 40) :] + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))) for _ in range(copies)) + part
    flat = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(text) - 199)
    at, group = V.equal_windows(flat, starts, 200)
    windows = [text[k : k + 200] for k in at.tolist()]
    assert windows == sorted(windows) and sorted(at.tolist()) == starts.tolist()
    assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    w = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [w(rnd.randint(180, 600)) for _ in range(4)]
    texts = [w(rnd.randint(0, 300)) + rnd.choice(passages) + w(rnd.randint(0, 300)) for _ in range(60)] + [w(400) for _ in range(20)]
    texts += ["a" * 700, "ab" * 300, "", None, "x" * 199, "y" * 200, "y" * 200, "z" * 201, w(9000)]
    return texts + texts[:5]


@pytest.mark.parametrize("many", [1024, 3, 0])
def test_against_brute_force(spark, rows, many):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, many).collect()}
    assert [found[k] for k in range(len(rows))] == slow([(t or "").encode() for t in rows])


def test_pieces_of_long_texts(spark, rows, monkeypatch):
    """A text that is cut into pieces gives the same windows."""
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdef") for _ in range(5000)).encode()
    powers = S.Powers()

    def windows(block):
        monkeypatch.setattr(S, "BLOCK", block)
        out = []
        for group in S.pieces([text, b"short", text[100:3000]]):
            joined, end = b"".join(b for _, _, b in group), np.cumsum([len(b) for _, _, b in group])
            begin = np.concatenate(([0], end[:-1]))
            if len(joined) < 200:
                continue
            anchor, at, first, last = S.snippets(np.frombuffer(joined, np.uint8), begin, end, powers)
            owner = np.searchsorted(end, first, side="right")
            for h, a, f, z, o in zip(anchor.tolist(), at.tolist(), first.tolist(), last.tolist(), owner.tolist(), strict=True):
                out += [(group[o][0], group[o][1] + k - int(begin[o]), h, a - k) for k in range(f, z + 1)]
        return sorted(out)

    whole = windows(1 << 20)
    assert whole == windows(700) and len(whole) == len(text) - 199 + 2900 - 199


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(odd_docs).collect())
    made = slow([(t or "").encode() for _, t in odd_rows])
    assert found == sorted((str(i), *m) for (i, _), m in zip(odd_rows, made, strict=True))
    assert S.remove_repeats(empty_docs).count() == 0


def test_without():
    assert S.without(b"0123456789", [(2, 4), (3, 6), (6, 7), (9, 10)]) == (b"0178", 6, 2)
    assert S.without(b"abc", []) == (b"abc", 0, 0)
