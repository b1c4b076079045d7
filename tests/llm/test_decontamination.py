import hashlib
import math
import random
import re

import pytest

from loomspace.llm import decontamination as D

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def cut(text):
    return re.findall(PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near_items(ws, items):
    """By the definition of proximity: every start, every pair, every place within the slack."""
    pairs, found = list(zip(ws, ws[1:], strict=False)), set()
    for i, t in items:
        own = cut(t)
        wanted = list(zip(own, own[1:], strict=False))
        if i is None or not wanted:
            continue
        need = max(1, math.ceil(len(wanted) * D.SHARE))
        for start in range(-len(own) - D.SLACK, len(ws) + D.SLACK + 1):
            there = sum(any(p in range(len(pairs)) and pairs[p] == w for p in range(start + off - D.SLACK, start + off + D.SLACK + 1)) for off, w in enumerate(wanted))
            if there >= need:
                found.add(str(i))
                break
    return sorted(found)


def slow(docs, items):
    windows = []
    for i, t in items:
        ws = cut(t)
        if i is not None and ws:
            k = min(10, len(ws))
            windows += [(str(i), ws[s : s + k]) for s in range(len(ws) - k + 1)]
    out = []
    for d, t in docs:
        ws, hit, found = cut(t), set(), set()
        for i, w in windows:
            for s in range(len(ws) - len(w) + 1):
                if ws[s : s + len(w)] == w:
                    hit.update(range(s, s + len(w)))
                    found.add(i)
        sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
        near = near_items(ws, items)
        out.append((str(d), len(ws), len(hit), len(found), sha(sorted(found)), bool(hit), len(near), sha(near)))
    return sorted(out)


def fast(docs, items):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near, r.near_sha256) for r in D.contamination(docs, items).collect())


ITEMS = [
    (1, "a b a b a b a b a b a b a b"), (2, "One two"), (10, "solo"), (9, "x y z x y z x y z x y z x y"), (3, None), (4, ""), (5, "  ...  "), (None, "never an item of ten words or more at all here"),
    (2, "ONE two"), (6, "é Ü 1 2 3"), (1, "second text of item one"), (7, "a a a a a a a a a a a a"),
]


@pytest.mark.parametrize(("broadcast", "keys"), [(200_000, 1 << 21), (0, 7)])
def test_against_brute_force(spark, monkeypatch, broadcast, keys):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(D, "BROADCAST_KEYS", keys)
    rnd = random.Random(4)
    texts = [None, "", "solo", "-solo-solo ", "one  TWO one", "É ü 1 2 3", "é Ü 1 2 3!", "a" + " a" * 30, "second text of item one"]
    texts += [" ".join(rnd.choice("a a b b x y z one two solo é".split()) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    texts += ["start " + " ".join(cut(ITEMS[0][1])[:11]) + " end", "z " + ITEMS[3][1] + " x"]
    rows = [*enumerate(texts), (None, "solo"), (None, "solo"), (3, "one two"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert fast(docs, items) == slow(rows, ITEMS)
    kept = D.decontaminated(docs, items)
    clean = sorted(r[0] for r in slow(rows, ITEMS) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean and kept.columns == docs.columns


def test_odd_rows(spark, odd_docs, empty_docs, odd_rows):
    texts = [t for _, t in odd_rows if t]
    rows = [(k, " ".join(t.split()[3:17])) for k, t in enumerate(texts) if len(t) < 5000][:12]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")
    assert fast(odd_docs, items) == slow(odd_rows, rows)
    assert fast(empty_docs, items) == []
    assert all(r[2] == 0 for r in fast(odd_docs, items.filter("false")))


def test_proximity(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [
        " ".join(words), " ".join(words[:5] + ["inserted"] + words[5:]), " ".join(words[:4] + words[5:]), "x " * 40 + " ".join(words[:6] + ["one", "two", "three"] + words[6:]),
        " ".join(words[:6] + ["far"] * 9 + words[6:]), " ".join(words[:7]), " ".join(w + " and" for w in words),
        # a pair three words too early and the others three too late, so that no pair stands at its exact place for the best start
        " ".join(words[8:10] + ["pad"] * 3 + words[:2] + ["pad"] * 2 + words[2:8]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = [(1, " ".join(words))]
    items = D.item_words(spark.createDataFrame(benchmark, "item_id long, text string"))
    found = {r.doc_id: r for r in D.proximity_matches(D.build_index(docs, items), items).collect()}
    assert set(found) == {k for k, t in enumerate(texts) if near_items(cut(t), benchmark)} >= {0, 1, 3}
    assert (found[0].start, found[0].n_pairs) == (-3, 11) and found[1].n_pairs == 10
