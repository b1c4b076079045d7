import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspace.llm import license_scan as L


def test_increasing_is_longest():
    def longest(v):
        return max((n for n in range(len(v) + 1) for c in itertools.combinations(v, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)

    for v in itertools.permutations(range(6)):
        found = L.increasing(list(v))
        assert len(found) == longest(v) and [v[k] for k in found] == sorted(v[k] for k in found)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from("abcdef"), max_size=30), st.lists(st.sampled_from("abcdef"), max_size=20))
def test_alignment_is_valid(doc, template):
    pairs = L.patience(doc, template)
    assert all(doc[a] == template[b] for a, b in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_equal_texts_align_whole():
    t = L.words_of(L.TEMPLATES["MIT-text"])
    assert len(L.patience(t, t)) == len(t)
    assert L.coverage(["x"] * 50 + t[:60] + ["inserted", "words"] + t[60:] + ["y"] * 20, t)[0] == 1


def brute_coverage(doc, template, threshold):
    """By the definition: the longest common subsequence of the template and any window of 2 * m + 16 words."""

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))
        return row[-1]

    share = max((longest(doc[k : k + 2 * len(template) + 16], template) for k in range(len(doc))), default=0) / len(template)
    return share if share >= threshold else 0


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("abcdefxyz"), max_size=80), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=8), st.sampled_from([0.5, 0.8, 1.0]))
def test_coverage_is_the_best_of_any_window(doc, template, threshold):
    share, first, last = L.coverage(doc, template, threshold)
    assert share == brute_coverage(doc, template, threshold)
    if share:
        assert L.common(doc[first : last + 1], template)[-1] == round(share * len(template)) and last - first < 2 * len(template) + 16
    else:
        assert (first, last) == (-1, -1)


def test_stray_words_of_a_template():
    t = L.words_of(L.TEMPLATES["MIT"])
    for gap in (30, 40, 5000):
        doc = L.words_of("It was released in 2019. " + "other words " * (gap // 2) + "Licensed under the MIT License.")
        assert L.coverage(doc, t) == (0.8, len(doc) - 4, len(doc) - 1)
        assert L.coverage(["x"] * 100 + doc, t)[0] == 0.8


def test_licenses_stated_twice(spark):
    line, text = L.TEMPLATES["MIT"], L.TEMPLATES["ISC-text"]
    rows = [(1, f"alpha {line} beta {line} gamma", "MIT"), (2, f"Copyright Ann {text} Copyright Bob {text}", "ISC-text"), (3, f"{text} " * 40, "ISC-text"), (4, f"{line} {text} " * 3, "ISC-text,MIT")]
    found = {r.doc_id: (r.licenses, r.coverage) for r in L.license_matches(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert found == {k: (names, 1.0) for k, _, names in rows}
    assert L.coverage(L.words_of(rows[0][1]), L.words_of(line)) == (1.0, 1, 5)


def test_licenses_go_by_their_names(spark):
    rows = [
        ("Released under the BSD License.", "BSD"), ("Licensed under CC BY 4.0.", "CC-BY-4.0-line"), ("Licensed under CC BY-ND 4.0.", ""), ("Licensed under the Apache License, Version 1.1", ""),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2. See section 3", "GPL-2.0"), ("It was released under pressure by the MIT under a license.", ""),
        ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Licensed under the MIT License", "MIT"), ("Licensed under the MIT (X11) License", "MIT"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ""),
    ]
    found = L.license_matches(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {rows[r.doc_id][0]: r.licenses for r in found} == dict(rows)


def test_each_template_is_its_own_best(spark):
    names = list(L.TEMPLATES)
    found = L.license_matches(spark.createDataFrame([(k, f"before {L.TEMPLATES[n]} after") for k, n in enumerate(names)], "doc_id long, text string")).collect()
    assert {names[r.doc_id]: (r.best, r.coverage) for r in found} == {n: (n, 1.0) for n in names}
    assert {names[r.doc_id] for r in found if r.n_licenses > 1} <= {"Apache-2.0-notice"}


def test_lines_are_found(spark):
    noise = "lorem ipsum the of under " * 2000
    rows = [
        (1, noise + "Released under the MIT License. " + noise, "MIT"),
        (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", "Apache-2.0"),
        (3, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0,GPL-3.0"),
        (4, "released " + noise + "under " + noise + "the mit " + noise + " license", ""),
        (5, noise, ""),
        (6, L.TEMPLATES["GPL-3.0-notice"].replace("more details", "further details"), "GPL-3.0-notice"),
    ]
    found = {r.doc_id: r.licenses for r in L.license_matches(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {k: set(v.split(",")) >= set(e.split(",")) if e else v == "" for (k, _, e), v in zip(rows, (found[r[0]] for r in rows), strict=True)} == {r[0]: True for r in rows}


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    found = L.license_matches(odd_docs).collect()
    assert len(found) == len(odd_rows) and {r.n_licenses for r in found} == {0}
    assert L.license_matches(empty_docs).count() == 0


def test_a_template_of_full_length():
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(700)]
    t = [rnd.choice(vocabulary) for _ in range(5600)]
    assert L.coverage(["x"] * 300 + t + ["y"] * 10, t) == (1.0, 300, 5899)
    worn = [w for k, w in enumerate(t) if k % 10]
    share, first, last = L.coverage(["x"] * 50 + worn, t)
    assert share == len(worn) / len(t) and (first, last) == (50, 49 + len(worn))


def brute_named(doc, template, name, threshold):
    """All windows that hold a place of the name, each side of it by all common subsequences."""
    m, span = len(template), 2 * len(template) + 16
    c, d = L.spots(template, name)[0]
    best = 0
    for p, q in L.spots(doc, name):
        for a in range(max(0, q - span), p + 1):
            for b in range(q, min(len(doc), a + span) + 1):
                parts = ((doc[a:p], template[:c]), (doc[p:q], template[c:d]), (doc[q:b], template[d:]))
                best = max(best, sum(L.common(x, y)[-1] if x and y else 0 for x, y in parts))
    return best / m if best / m >= threshold else 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from("abcnox"), max_size=45), st.lists(st.sampled_from("abc"), max_size=3), st.lists(st.sampled_from("abc"), max_size=3), st.sampled_from([0.5, 0.8]))
def test_named_coverage_is_the_best_of_any_window(doc, before, after, threshold):
    template = [*before, "n", "o", *after]
    share, first, last = L.named_coverage(doc, template, "n (?:x )?o", threshold)
    assert share == brute_named(doc, template, "n (?:x )?o", threshold)
    assert not share or last - first < 2 * len(template) + 16


def test_matches_against_brute_force(spark):
    """Whole results over short random documents, names and thresholds included."""
    rnd = random.Random(11)
    templates = {"one": "a b c d e", "two": "licensed under the n o license", "three": "b a"}
    names = {"two": "n o"}
    texts = ["".join(w + " " for w in rnd.choices("a b c d e licensed under the n o license x".split(), k=rnd.randint(0, 40))) for _ in range(150)]
    texts += ["licensed under x y the n o license", "a b x c d e a b c d e", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.license_matches(docs, templates, 0.8, names).collect():
        doc = L.words_of(texts[r.doc_id] or "")
        shares = {k: brute_named(doc, t.split(), names[k], 0.8) if k in names else brute_coverage(doc, t.split(), 0.8) for k, t in templates.items()}
        found = {k: v for k, v in shares.items() if v}
        best = min(found, key=lambda k: (-found[k], -len(templates[k].split()), k), default=None)
        assert (r.licenses, r.n_licenses, r.best, r.coverage) == (",".join(sorted(found)), len(found), best, found.get(best, 0.0)), texts[r.doc_id]
