import random

import pytest
from samples import prose

from scoreloom.llm import licenses as L


@pytest.fixture(scope="module")
def model(docs):
    return L.train(docs)


def found(df, model):
    return {r.doc_id: [(n.start, n.end, n.family) for n in r.notices] for r in L.scan_licences(df, model).collect()}


def test_notices_in_documents(docs, model):
    notices = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}
    out, seen = found(docs, model), 0
    for r in docs.collect():
        expected = [notices[x] for x in r.text.split("\n") if x in notices]
        assert [f for _, _, f in out[r.doc_id] if f != "unknown"] == expected
        assert all(r.text[a:b] in notices for a, b, f in out[r.doc_id] if f != "unknown")
        seen += len(expected)
    assert seen


def test_held_out_variants(spark, model):
    rows = [
        (0, f"é {prose(1, 30)}\nCode released under the MIT license\nend"),
        (1, "distributed under terms of the Apache License 2.0 by us"),
        (2, prose(2, 200)),
        (3, f"{prose(3, 70)} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {prose(4, 70)}"),
        (4, "the dinner was free and the software of the city was old"),
    ]
    out = found(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert [f for *_, f in out[0]] == ["mit"] and [f for *_, f in out[1]] == ["apache-2.0"] and [f for *_, f in out[3]] == ["mit"]
    assert not [x for i in (2, 4) for *_, x in out[i] if x != "unknown"]
    a, b, _ = out[0][0]
    assert rows[0][1][a:b] == "Code released under the MIT license"


def test_every_notice_of_a_paragraph(spark, model):
    mit, gpl, end = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved."
    rows = [
        (0, f"{mit} {prose(1, 60)} {gpl} {prose(2, 60)} {end}"),
        (1, f"{mit} {gpl}"),
        (2, f"{prose(3, 40)}\n{end}\n{end}\n{prose(4, 40)}"),
        (3, f"{prose(5, 20)}\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation\n{prose(6, 20)}"),
        (4, "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."),
    ]
    out = found(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert [f for *_, f in out[0]] == ["mit", "gpl", "proprietary"]
    assert [rows[0][1][a:b] for a, b, _ in out[0]] == [mit, gpl, end]
    assert [f for *_, f in out[1]] == ["mit", "gpl"] and [f for *_, f in out[2]] == ["proprietary"] * 2
    assert [f for *_, f in out[3]] == ["gpl"] and rows[3][1][slice(*out[3][0][:2])].startswith("This program") and rows[3][1][slice(*out[3][0][:2])].endswith("Foundation")
    assert [f for *_, f in out[4]] == ["cc-by-sa", "cc-by", "cc-by-nc"]


def wrapped(text, rng, lost):
    """A notice as it may be met: other case and marks, a share of words lost, lines of its own length, prose around it."""
    words = [w.upper() if rng.random() < 0.1 else w.strip(",.") if rng.random() < 0.3 else w for w in text.split() if rng.random() >= lost]
    lines, k = [], rng.randint(4, 9)
    for i in range(0, len(words), k):
        lines.append(" ".join(words[i : i + k]))
    return f"{prose(rng.randrange(10**6), rng.randint(0, 60))}\n" + "\n".join(lines) + f"\n{prose(rng.randrange(10**6), rng.randint(0, 60))}"


@pytest.mark.parametrize(("lost", "least"), [(0.0, 0.97), (1 / 12, 0.85)])
def test_recall_of_changed_notices(spark, model, lost, least):
    rng = random.Random(11)
    rows = [(i, wrapped(t, rng, lost), name) for i, (name, t) in enumerate((n, t) for n, ts in L.TEMPLATES.items() for t in ts for _ in range(12))]
    rows += [(1000 + i, prose(5000 + i, 300), "") for i in range(200)]
    out = found(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model)
    known = [{f for *_, f in out[i]} - {"unknown"} for i, *_ in rows]
    right = [name in k for k, (*_, name) in zip(known, rows, strict=True) if name]
    print("recall", sum(right) / len(right), "alone", sum(k == {name} for k, (*_, name) in zip(known, rows, strict=True) if name) / len(right))
    assert sum(right) >= least * len(right)
    assert not any(k for k, (*_, name) in zip(known, rows, strict=True) if not name)


def test_odd_rows(odd, odd_rows, none, model):
    assert L.scan_licences(odd, model).count() == len(odd_rows)
    assert L.scan_licences(none, model).count() == 0
    assert L.train(none).names == list(L.TEMPLATES)
