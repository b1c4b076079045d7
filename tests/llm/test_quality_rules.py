import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspace.llm import quality_rules as R


def brute_repeats(words):
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    return len({j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)})


def slow(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, brute_repeats(ws)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\x0b", "\x1c", "\x85", "日本"]), max_size=120).map("".join))
def test_measures(text):
    assert R.measure(text)[:5] == slow(text)


def corpus(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows = []
    for k in range(200):
        ws = [word() for _ in range(rnd.randint(30, 200))]
        kind = k % 10
        text = " ".join(ws)
        if kind == 0:
            text = " ".join(w + "%%%" for w in ws)
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in ws)
        rows.append((k, text, kind > 1))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), {r[0]: r[2] for r in rows}


def test_junk_goes_and_clean_stays(spark):
    docs, clean = corpus(spark)
    kept = {r.doc_id: r.kept for r in R.quality_rules(docs).collect()}
    assert kept == clean
    assert {r.doc_id for r in R.quality_filter(docs).collect()} == {k for k, v in clean.items() if v}


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    found = R.quality_rules(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((str(i), *slow(t)) for i, t in odd_rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    stay = R.quality_filter(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == sum(r.kept for r in found)
    assert R.quality_rules(empty_docs).count() == R.quality_filter(empty_docs).count() == 0


def test_fit_without_texts_and_orientation():
    names = ["a", "b", "c"]
    assert R.fit_votes([], names).prior == R.PRIOR
    for good, bad in ((900, 100), (100, 900)):
        model = R.fit_votes([((1, 1, 1), good), ((-1, -1, -1), bad)], names)
        assert all(g > 0 > b for g, _, b in model.weights.values()) and model.prior == pytest.approx(good / 1000, abs=0.01)


def brute_posteriors(votes):
    """EM text by text, from the definition of the model: one list of votes per text."""
    rules = range(len(votes[0]))
    rate = [{(j, v): R.START[y][k] for j in rules for k, v in enumerate((1, 0, -1))} for y in (0, 1)]
    prior, post = R.PRIOR, []
    for _ in range(3000):
        now = []
        for text in votes:
            a, b = 1 - prior, prior
            for j, v in enumerate(text):
                a, b = a * rate[0][j, v], b * rate[1][j, v]
            now.append(b / (a + b))
        for y in (0, 1):
            mass = [p if y else 1 - p for p in now]
            rate[y] = {(j, v): (sum(w for w, t in zip(mass, votes, strict=True) if t[j] == v) + R.WORTH * R.START[y][k]) / (sum(mass) + R.WORTH) for j in rules for k, v in enumerate((1, 0, -1))}
        prior = (sum(now) + R.WORTH * R.PRIOR) / (len(now) + R.WORTH)
        done = post and max(abs(p - q) for p, q in zip(now, post, strict=True)) < 1e-9
        post = now
        if done:
            break
    out = []
    for text in votes:
        x, y = 1 - prior, prior
        for j, v in enumerate(text):
            x, y = x * rate[0][j, v], y * rate[1][j, v]
        out.append(y / (x + y))
    return out


def test_posterior_against_brute_force(spark):
    docs, _ = corpus(spark)
    names = list(R.rules())
    rows = R.quality_rules(docs).collect()
    fitted = [r for r in rows if not r.base_failed]
    wanted = brute_posteriors([[r[f"vote_{k}"] for k in names] for r in fitted])
    assert [r.quality for r in fitted] == pytest.approx(wanted, abs=1e-6)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in rows)


def test_verdict_is_not_a_conjunction(spark):
    """A bad vote that the other rules do not bear out rejects nothing; votes that go together do."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    rows = [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows += ["\n".join(["same old line"] * 3 + [" ".join(word() for _ in range(20)) for _ in range(3)]) for _ in range(4)]  # repeated lines, nothing else
    rows += [" ".join(word() + "%%%" for _ in range(60)) for _ in range(40)]
    found = {r.doc_id: r for r in R.quality_rules(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(found[k].kept and found[k].vote_lines == -1 for k in range(300, 304))
    assert all(found[k].kept for k in range(300)) and not any(found[k].kept for k in range(304, 344))


def test_variety_at_any_length(spark):
    rnd = random.Random(5)
    rows = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[:n]) + "ord" for _ in range(size)) for n, size in ((3, 60), (20, 2001), (20, 20_000))]
    found = R.quality_rules(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.vote_variety for r in found.collect()} == {-1}
