import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from loomspace.llm import components as C
from loomspace.llm import simhash_dedup as S


def slow_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), 42) for k in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(items, linked):
    """Least member reachable, by brute force."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_every_close_pair_meets():
    rnd = random.Random(1)
    masks = S.covering_masks(list(range(64)))
    assert len(masks) == 15 and {m.bit_count() for m in masks} == {32}
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(a & m == b & m for m in masks)
    for mask, inner in S.tables():
        assert all(m & mask == 0 and m.bit_count() == 16 for m in inner)
        free = [p for p in range(64) if not mask >> p & 1]
        for spots in itertools.combinations(free[::4], 3):
            assert any(not any(m >> p & 1 for p in spots) for m in inner)


@pytest.mark.parametrize("small", [256, 2, 0])
def test_links_against_all_pairs(spark, small):
    rnd = random.Random(2)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 4))))
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = sorted(S._signed(f) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    made = S.links(df, small)
    assert made.filter("bit_count(u ^ v) > 3 and false").count() == 0
    found = {r.node: r.root for r in C.components(made).collect()}
    wanted = groups(signed, lambda a, b: (a ^ b).bit_count() <= 3 if (a < 0) == (b < 0) else ((a & (2**64 - 1)) ^ (b & (2**64 - 1))).bit_count() <= 3)
    assert all(found.get(f, f) == wanted[f] for f in signed)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 50)]
    found = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[k] == 0 for k in range(61)) and found[101] == 100 and all(found[200 + k] == 200 for k in range(50))
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    found = S.simhash_components(odd_docs).collect()
    assert len(found) == len(odd_rows)
    by_text = {t or "": slow_fingerprint(t) for _, t in odd_rows}
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), f"{by_text[t or '']:016x}") for i, t in odd_rows)
    fps = {f: min((i for i, t in odd_rows if i is not None and by_text[t or ""] == f), default=None) for f in set(by_text.values())}
    root = groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    for r in found:
        mine = root[int(r.fingerprint, 16)]
        assert r.component_id == min((fps[f] for f in fps if root[f] == mine and fps[f] is not None), default=None)
    assert S.simhash_components(empty_docs).count() == 0


def test_filter_keeps_one_of_each_group(odd_docs, empty_docs, odd_rows):
    kept = S.simhash_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    by_text = {t: slow_fingerprint(t) for _, t in odd_rows}
    root = groups(sorted(set(by_text.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    found = kept.collect()
    assert sorted(root[by_text[r.text]] for r in found) == sorted(set(root.values()))
    every = {tuple(r) for r in odd_docs.collect()}
    assert all(tuple(r) in every for r in found)
    assert S.simhash_filter(empty_docs).count() == 0


def test_forest_does_not_emit_pairs():
    fp = np.array([0, 1, 2, 3, 7], np.uint64)
    u, v = S.near_links(np.zeros(5, int), fp)
    assert len(u) == 4
