import corpus_pipeline
from test_decontaminate import brute as contained
from test_linedup import brute as repeated
from test_simhash import components, reference

from scoreloom.llm import toxicity


def test_every_stage_equals_brute_force(spark, sf_dir, docs, labels):
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = step(spark, now, sf_dir)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
            assert after == {i: t for i, t in before.items() if not scores[i]}
        elif name == "line_dedup":
            gone = repeated(list(before.items()))
            assert after.keys() == before.keys()
            assert all((after[i] == before[i]) == (gone[i] == 0) for i in after)
        elif name == "simhash_near_dedup":
            root = components({i: reference(t) for i, t in before.items()})
            assert after == {i: t for i, t in before.items() if root[i] == i}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            leaked = {f[0] for f in contained(list(before.items()), items)}
            assert after == {i: t for i, t in before.items() if i not in leaked}
    out = steps["mixing"](spark, now, sf_dir)
    assert out.columns == [*docs.columns, "rate"] and out.where("rate > 0").count() == out.count() > 0


def test_odd_rows_go_through_every_stage(spark, sf_dir, odd, odd_rows, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs, most in ((odd.select(columns), len(odd_rows)), (none.select(columns), 0)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, sf_dir)
            assert out.columns == columns + ["rate"] * (name == "mixing") and out.count() <= most
    kept = corpus_pipeline.drop_near_duplicates(spark, odd.select(columns), sf_dir)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 8, 9, 9]


def test_run_deletes_what_stages_leave_behind(spark, sf_dir):
    from pathlib import Path

    home = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(home.iterdir())
    rows = corpus_pipeline.run(spark, sf_dir).count()
    left = {p.name.rsplit("-", 1)[0] for p in set(home.iterdir()) - before}
    assert rows and left == {"scoreloom-mixing"}


def test_run_returns_the_last_stage(spark, sf_dir):
    assert "rate" in corpus_pipeline.run(spark, sf_dir).columns
