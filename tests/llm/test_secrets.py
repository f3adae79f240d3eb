import random
import re

from scoreloom.llm import secrets as S

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def spans(text):
    return sorted((m.start(), i, m.end(), k, m.group(g)) for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n)


def test_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    parts = ["password", "Token", " ", "=", ":", '"', "'", "abcdef0123", "AKIA", "ABCDEFGH", "é", "😀", "api_key", "secret", ".", "x", "0123456789abcdef", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), "s", "en") for i in range(400)]
    found = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(found) == 400
    for r in found:
        assert [tuple(s) for s in r.spans if s.nr < 3] == spans(texts[r.doc_id])
        assert r.n_live + r.n_example == len(r.spans)


def test_ownership(spark):
    copied, own = "password=EXAMPLEexample1", "token=abcdefghijklmn0p"
    rows = [(i, f"x {copied} y", f"src{i}", "en") for i in range(5)] + [(9, f"{own} and {copied}", "src9", "en"), (10, own, "src9", "de")]
    out = {r.doc_id: r for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert (out[9].n_live, out[9].n_example) == (1, 1) and [s.value for s in out[9].live_spans] == ["abcdefghijklmn0p"]
    assert (out[0].n_live, out[0].n_example) == (0, 1) and out[10].n_live == 1


def test_repositories_count(spark):
    spread, reused = "token=spreadspread00001", "token=reusedreused00001"
    rows = [(i, spread, f"src{i % 2}", f"l{i}") for i in range(5)] + [(10 + i, reused, "src0", f"l{i}") for i in range(6)] + [(20 + i, "token=pairpairpair00001", f"src{i}", "en") for i in range(2)]
    out = {r.doc_id: (r.n_live, r.n_example) for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert out[0] == (0, 1), "five repositories of two owners"
    assert out[10] == (1, 0), "six repositories of one owner"
    assert out[20] == (1, 0)


def test_a_text_with_very_many_matches(spark):
    text = " ".join(f"é token=abcdefghijkl{i:05d}" for i in range(3000))
    (r,) = S.find_secrets(spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")).collect()
    assert [tuple(s) for s in r.spans if s.nr < 3] == spans(text) and len(r.spans) == 3000


def test_odd_rows(odd, odd_rows, none):
    out = S.find_secrets(odd)
    assert out.count() == len(odd_rows) and S.find_secrets(none).count() == 0
    assert all(r.spans == [] and r.n_live == 0 for r in out.collect())
    assert S.redact(odd).schema == odd.schema


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdefghijkl é token: 0123456789abcdef0 b"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in S.redact(df).orderBy("doc_id").collect()] == ["a password=[secret] é token: [secret] b", None, "none"]
