import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from scoreloom.llm import tokens as T


@pytest.fixture(scope="module")
def pieces():
    return T.load_pieces()


def library_count(pieces):
    """Counts by the tokenizers library with the same pieces; unknown runs count as bytes."""
    t = Tokenizer(models.Unigram(vocab=[("<unk>", min(pieces.values())), *pieces.items()], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")

    def count(text):
        e = t.encode(text)
        return sum(1 if i else len(text[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets, strict=True))

    return count


def test_counts_equal_the_library(docs, pieces):
    count = library_count(pieces)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(docs, pieces).collect()} == {i: count(t) for i, t in texts.items()}


def test_random_strings(pieces):
    rng, count, model = random.Random(0), library_count(pieces), T.Unigram(pieces)
    for _ in range(300):
        text = "".join(rng.choice("abc déßñ▁\n 😀漢x  the") for _ in range(40))
        parts = T.pre_tokens(text)
        known = model.counts(set(parts))
        assert sum(known[p] for p in parts) == count(text), text


def test_prefixes_are_shared_not_changed(pieces):
    model = T.Unigram(pieces)
    words = ["▁inter", "▁international", "▁internationally", "▁int", "▁"]
    assert model.counts(words) == {w: model.counts([w])[w] for w in words}


def test_long_pre_tokens_are_read_in_a_window(pieces, monkeypatch):
    import tracemalloc

    rng, model = random.Random(1), T.Unigram(pieces)
    tokens = ["▁" + "".join(rng.choice("abcdeinthsß😀漢") for _ in range(n)) for n in (1, 3, 40, 400, 3000)]
    expected = model.counts(tokens)
    monkeypatch.setattr(T, "LONG", 2)
    assert model.counts(tokens) == expected
    long = tokens[-1] * 100
    tracemalloc.start()
    assert model.counts([long])[long] > 0
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_odd_rows(odd, odd_rows, none, pieces, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 50)
    out = T.token_counts(odd, pieces).collect()
    assert len(out) == len(odd_rows) and T.token_counts(none, pieces).count() == 0
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (3, 4))
