import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspace.llm import bpe as B
from loomspace.llm import bytewords as W
from loomspace.llm import token_counts as K
from loomspace.llm.lexicon import Lexicon, _minimal, compile_lexicon


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="session")
def encoder(tokenizer):
    plain = B.ByteBpe(tokenizer)
    return B.ByteBpe(tokenizer, Lexicon(B.lexicon_of([" the", " and", "the", " it's 12 !!", " étude", " aaaa"], plain)))


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "ß", "日本", "12", "²", "!!", "|", "<|endoftext|>", "<|endof", "😀", "́", "　", "\x85", "\x1c", "ab" * 40, "՘", "x" * 300])


@settings(deadline=None, max_examples=400)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), max_size=4))
def test_encoding_is_the_library_s(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert encoder.decode(ids.tolist()) == library.decode(wanted, skip_special_tokens=False) == text


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_any_text(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decoding_any_ids(encoder, library, ids):
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words(encoder, library):
    rnd = random.Random(3)
    for text in ("".join(rnd.choice("abcdefgh") for _ in range(5000)), "a" * 3000, "ab" * 2000):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_lexicon():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["", "car", "cars", "star", "stars", "bar", "bars", "é"])}
    edges, final, _ = _minimal(sorted(words))
    assert len(edges) < sum(map(len, words))  # endings are shared
    assert sum(final) == len({(f, tuple(e.items())) for f, e in zip(final, edges, strict=True) if f})
    lexicon = Lexicon(compile_lexicon(words))
    probe = [*sorted(words), b"ca", b"carss", b"x"]
    size = np.array([len(w) for w in probe])
    found = lexicon.find(np.frombuffer(b"".join(probe), np.uint8), np.cumsum(size) - size, size)
    assert found.tolist() == [*range(len(words)), -1, -1, -1]
    for k, w in enumerate(sorted(words)):
        assert lexicon.ids[lexicon.offsets[k] : lexicon.offsets[k + 1]].tolist() == words[w]
    assert Lexicon(compile_lexicon({})).find(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1])).tolist() == [-1]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(W, "_table", lambda: np.ones((64, 256), np.uint64))
    flat = np.frombuffer(b"ab" b"ba" b"ab" b"abc", np.uint8)
    first, inverse = W.distinct(flat, np.array([0, 2, 4, 6]))
    assert inverse[0] == inverse[2] and len({inverse[0], inverse[1], inverse[3]}) == 3 and len(first) == 3


@pytest.mark.parametrize("words", [B.WORDS, 3])
def test_query_on_odd_rows(odd_docs, empty_docs, odd_rows, tokenizer, library, words):
    def wanted(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = B.bpe_round_trip(odd_docs, tokenizer, words).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted((str(i), *wanted(t)) for i, t in odd_rows)
    encoded = B.bpe_encode(odd_docs, tokenizer, words)
    back = sorted((str(r.doc_id), r.text) for r in B.bpe_decode(encoded, tokenizer).collect())
    assert back == sorted((str(i), t or "") for i, t in odd_rows)
    assert B.bpe_round_trip(empty_docs, tokenizer, words).count() == 0


def test_frequent_words_are_complete(spark):
    rows = [(k, "often " * 5 + f"rare{k} middling" * (k % 2)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert B.frequent_words(docs, 1) == ["often"]


@pytest.mark.parametrize("keys", [K.BROADCAST_KEYS, 0])
def test_counts_and_cache(spark, odd_docs, empty_docs, odd_rows, tokenizer, library, tmp_path, keys):
    cache = f"file://{tmp_path}/cache"
    wanted = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in odd_rows)
    for _ in range(2):  # from an empty cache, then from a full one
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in K.token_counts(odd_docs, tokenizer, cache, keys=keys).collect()) == wanted
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in odd_rows})
    more = spark.createDataFrame([(1, "a text that was not there before"), (2, odd_rows[0][1])], "doc_id long, text string")
    assert K.token_counts(more, tokenizer, cache, keys=keys).count() == 2
    assert spark.read.parquet(cache).count() == 1 + len({t or "" for _, t in odd_rows})
    assert K.token_counts(empty_docs, tokenizer).count() == 0


def test_another_version_is_counted_anew(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Hello there, naïve café")], "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    counts = [K.token_counts(docs, public_tokenizers.path(name), cache).first().n_tokens for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.json")]
    assert counts[0] == counts[2] and spark.read.parquet(cache).count() == 2


def test_a_second_run_of_the_query_encodes_nothing(spark, tmp_path, monkeypatch):
    from loomspace.llm.queries import op4_token_counts

    spark.createDataFrame([(k, f"text number {k % 7}") for k in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(op4_token_counts(spark, str(tmp_path)).collect())
    monkeypatch.setattr(K, "encode_counts", lambda *_: pytest.fail("encoded again"))
    assert sorted(op4_token_counts(spark, str(tmp_path)).collect()) == first and len(first) == 20


def test_other_tokenizers_go_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello there", "", "naïve  café 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.n_tokens for r in K.token_counts(docs, path).orderBy("doc_id").collect()]
    assert found == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    with pytest.raises(ValueError):
        B.ByteBpe(path)
