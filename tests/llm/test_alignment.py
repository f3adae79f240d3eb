import hashlib
import random
from collections import Counter, defaultdict

import pytest
from samples import prose

from scoreloom.llm import alignment as A


@pytest.fixture(scope="module")
def sides():
    return A.ByteSide(), A.PieceSide()


def whole(sides, text):
    """Tokens of the whole text with their byte ranges, or None."""
    if not text:
        return None
    out = []
    for side in sides:
        ids, at, ranges = side.ids(text), 0, []
        for i in ids:
            ranges.append((i, at, at + len(side.bytes[i])))
            at = ranges[-1][2]
        if b"".join(side.bytes[i] for i in ids) != b" " + text.encode():
            return None
        out.append(ranges)
    return out


def links(a, b):
    return [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]


def brute(sides, docs):
    """The contract's rows by byte offsets of whole texts."""
    found, held = [], Counter()
    for _, text in docs:
        tokens = whole(sides, text)
        pairs = links(*tokens) if tokens else []
        held.update(set(pairs))
        found.append((tokens, pairs))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), (tokens, pairs) in zip(docs, found, strict=True):
        if not tokens:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = tokens
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        cut = [[",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)] for lo, hi in zip([0, *ends], ends)]
        text = ";".join("|".join(x) for x in cut)
        out.append((i, len(a), len(b), len(ends), len(pairs), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in A.alignment(df).collect()), key=repr)


ODD = ["a", " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "\t x", "a  b", "à b à　 c", "x▁y", "<s> </s> <|endoftext|> <unk> <0x0A>", "don't we'll I'M", "ﬁ ﬂ", "a\x00b \x01 c", "﻿word", "中文 字 漢字", "😀 👩‍👩‍👧 é é", "1234567890 12 3", "...,,, !!! ???", "x" * 700 + " y", "word " * 5, "  x  y  z", "\x1c a \x85 b"]


@pytest.mark.parametrize("seed", range(3))
def test_parts_equal_whole_texts(sides, seed):
    rng = random.Random(seed)
    aligner = A.Aligner(*sides)
    bits = [" ", "  ", "\n", "\t", " ", "　", "▁", "a", "the", "'s", "é", "à", "中", "😀", "12", "#", "x" * 300, "<s>", "​", "\x85"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    import numpy as np
    import pyarrow as pa

    from scoreloom.llm import bytescan as B

    for _, data, offsets in B.chunks(pa.array(texts)):
        starts, ends, full, first = A.cut(data, offsets)
        where, store = aligner.parts(data, starts, ends), aligner.store
        for k in range(len(offsets) - 1):
            own = where[first[full[k]] : first[full[k] + 1]] if full[k] < full[k + 1] else where[:0]
            tokens = whole(sides, texts[k])
            assert (len(own) > 0 and not store.sizes[own, 4].any()) == bool(tokens), repr(texts[k])
            if tokens:
                assert store.sizes[own, 0].sum() == len(tokens[0]) and store.sizes[own, 1].sum() == len(tokens[1])
                pairs = np.concatenate([store.links[store.first[x] : store.first[x + 1]] for x in own])
                assert sorted(np.stack(np.divmod(pairs, aligner.kinds), 1).tolist()) == sorted(map(list, links(*tokens)))


def test_equals_brute_force(spark, sides, docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("length(text) < 4000").collect()]
    texts += [(1000 + k, t) for k, t in enumerate(ODD)] + [(5, prose(1, 30))] * 2
    assert found(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)) == brute(sides, texts)


def test_odd_rows(odd, odd_rows, sides, none):
    short = [r[:2] for r in odd_rows if len(r[1] or "") < 10_000]
    assert found(odd.where("length(text) < 10000 or text is null")) == brute(sides, short)
    whole_rows = {r[0]: r for r in found(odd)}
    assert len(found(odd)) == len(odd_rows) and whole_rows[6][1:] == whole_rows[7][1:] and whole_rows[6][1] > 60_000
    assert found(none) == []


def test_a_table_of_any_size_gives_the_same(docs, monkeypatch):
    few = docs.limit(40)
    one = found(few)
    monkeypatch.setattr(A, "BROADCAST", 0)
    monkeypatch.setattr(A, "KEPT", 50)
    monkeypatch.setattr(A, "TRANSITIONS", 50)
    assert found(few) == one


def test_transitions_are_found_once(sides):
    import numpy as np

    t = A.Transducer(*(s.bytes for s in sides))
    one = lambda text: [x for s in sides for x in (np.array(s.ids(text)), np.array([0, len(s.ids(text))]))]
    first = [x.tolist() for x in t.align(*one("unbelievable internationalisation"))]
    made = len(t.next)
    assert [x.tolist() for x in t.align(*one("unbelievable internationalisation"))] == first and len(t.next) == made
    a, a_first, *_ = one("unbelievable internationalisation")
    with pytest.raises(ValueError, match="differ"):
        t.align(a, a_first, *one("something else")[2:])


def test_groups_hash_to_the_digest(docs):
    few = docs.limit(20)
    digests = {r.doc_id: r.groups_sha256 for r in A.alignment(few).collect()}
    for r in A.groups(few).collect():
        assert digests[r.doc_id] == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
