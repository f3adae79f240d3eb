import re
from collections import Counter

from scoreloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def check(df):
    for r in Q.quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.base_failed and r.kept)


def test_base_measures(docs):
    check(docs)


def test_odd_rows(odd, odd_rows, none):
    check(odd)
    assert Q.quality(odd).count() == len(odd_rows) and Q.quality(none).count() == 0
    assert "extra" in Q.quality(odd).columns and Q.quality(odd).columns.count("n_words") == 1


def test_windows_at_the_edges(spark):
    texts = ["a b c", "a b c a b c", "a a a a", "a a a", "x y z w x y z", " ".join(["q"] * 500), "\x0ba\x0cb\rc\n\n"]
    check(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_good_documents_are_kept(docs, labels):
    rows = Q.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)
