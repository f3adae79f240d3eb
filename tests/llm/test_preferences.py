from scoreloom.llm import preferences as P

TURNS = "conv_id long, turn long, role string, text string, prompt string, p int, c int, r int"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_longest_common_prefix(spark):
    turn = "array<struct<role:string,text:string>>"
    cases = [
        ([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "good é😀")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "bad")]),
        ([("user", "a")], [("user", "z")]),
        ([("user", "a"), ("assistant", "b")], [("user", "a")]),
        ([("user", "a")], [("user", "a")]),
        (None, [("user", "a"), ("assistant", "x")]),
    ]
    out = P.format_pairs(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, chosen_turns {turn}, rejected_turns {turn}")).orderBy("i").collect()
    for r, (a, b) in zip(out, cases, strict=True):
        a, b = a or [], b or []
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for text, spans, turns in ((r.chosen, r.chosen_spans, a[n:]), (r.rejected, r.rejected_spans, b[n:])):
            assert [text[s.start : s.end] for s in spans] == [f"{t}<|end|>\n" for role, t in turns if role == "assistant"]


def test_odd_turns(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 1, "assistant", "one"), (1, 0, None, None), (1, 1, "assistant", "two"),
        (2, 0, "user", "alone"), (4, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "user", "x"), (6, None, "assistant", "a"), (7, 2, "user", "no reply"),
    ]
    df = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], TURNS)
    out = {r.pair_id: r for r in P.format_pairs(P.reply_pairs(df)).collect()}
    assert set(out) == {0, 1}
    assert (out[0].prompt, out[0].chosen, out[0].rejected) == (render([("user", "q")]), render([("assistant", "one")]), render([("assistant", "two")]))
    assert out[1].prompt == render([("user", "")])
    assert P.reply_pairs(df.where("conv_id > 99")).count() == 0


def test_columns_of_clashing_names_stay(spark):
    turn = "array<struct<role:string,text:string>>"
    side = [("user", "a"), ("assistant", "b")]
    row = P.format_pairs(spark.createDataFrame([(side, side[:1], "own p", 2, 3.0, "old")], f"chosen_turns {turn}, rejected_turns {turn}, p string, C int, r double, prompt string")).first()
    assert (row.p, row.C, row.r) == ("own p", 2, 3.0) and row.prompt == render(side[:1]) and row.chosen == render(side[1:])
