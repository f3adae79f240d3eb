"""Planted truths: results that are known beforehand."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import scalars as C
from scoreloom.functions import texts as X
from scoreloom.operators import dedupe as D
from scoreloom.operators import evidence as E
from scoreloom.operators import integrity as I
from scoreloom.operators import metrics as M
from scoreloom.operators import models as L
from scoreloom.operators import ordering as O
from scoreloom.operators import raster
from scoreloom.plans.chain_queries import CURVE
from scoreloom.sources import files
from scoreloom.streaming import scans as W


def rows(spark, score):
    data = [(f"i{i}", i % 2, float(score(i % 2, i)), f"c{i // 4}:{i % 2}") for i in range(200)]
    return spark.createDataFrame(data, "image_id string, label int, score double, cluster_id string")


def test_constant_and_inverted_scores(spark):
    assert M.point_metrics(rows(spark, lambda y, i: 0.7), 0.65).first().balanced_accuracy == 0.5
    assert M.point_metrics(rows(spark, lambda y, i: 0.1), 0.65).first().balanced_accuracy == 0.5
    assert M.point_metrics(rows(spark, lambda y, i: 1 - y), 0.65).first().balanced_accuracy == 0.0
    assert M.two_sided_stump(rows(spark, lambda y, i: 1 - y)).first().polarity == -1


def test_not_finite_scores_never_agree(spark):
    r = rows(spark, lambda y, i: float("nan"))
    assert M.point_metrics(r, 0.65).first().balanced_accuracy == 0.0


def test_interval_holds_the_point_and_repeats(spark):
    r = rows(spark, lambda y, i: 0.4 + 0.3 * y + 0.3 * math.sin(i * 12.9898) / 2)
    one, two = ({x.metric: tuple(x) for x in M.clustered_interval(r, 0.65, 200).collect()} for _ in range(2))
    assert one == two
    for m in one.values():
        assert m[2] <= m[1] <= m[3]
    poisson = {x.metric: x for x in M.clustered_interval(r, 0.65, 200, method="poisson").collect()}
    assert all(abs(poisson[k].ci_lower - one[k][2]) < 0.1 for k in one)
    with pytest.raises(ValueError):
        M.clustered_interval(r, 0.65, 10)


def test_auc_and_sweep_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, score double")
    pos, neg = ([s for y, s in data if y == k] for k in (1, 0))
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert M.roc_auc(df).first().auc == pytest.approx(pairs / len(pos) / len(neg))
    ba = lambda t: (sum(p >= t for p in pos) / len(pos) + sum(n < t for n in neg) / len(neg)) / 2
    best = max(sorted({s for _, s in data}), key=lambda t: (ba(t), -t))
    found = M.best_threshold(df).first()
    assert (found.threshold, found.balanced_accuracy) == (best, pytest.approx(ba(best)))
    assert M.best_threshold(df.where("label = 1")).count() == 0


def test_permutation_gate_tells_a_leak_from_noise(spark):
    leak = M.permutation_gate(rows(spark, lambda y, i: 0.2 + 0.6 * y), samples=200).first()
    noise = M.permutation_gate(rows(spark, lambda y, i: (i * 7919 % 101) / 101), samples=40).first()
    assert leak.verdict == "fail" and leak.observed == 1.0 and noise.verdict != "fail"


def test_running_totals_and_dense_index(spark):
    df = spark.createDataFrame([(k, float(v), 1) for k in "ab" for v in [5, 1, 3, 2, 4, 1e9]], "k string, v double, n int")
    out = {(r.k, r.v): (r.n_to, r.n_all) for r in O.running_totals(df, "v", ["n"], ["k"]).collect()}
    assert [out["a", v] for v in (1.0, 2.0, 3.0, 4.0, 5.0, 1e9)] == [(i, 6) for i in range(1, 7)]
    index = O.dense_index(df.select("k", "v"), "v", ["k"]).collect()
    assert sorted(r.idx for r in index if r.k == "a") == list(range(6)) and {r.idx_n for r in index} == {6}


def test_curves(spark):
    x = spark.range(0, 201).select((F.col("id") / 100 - 0.5).alias("x"))
    y = [r.y for r in x.select(C.apply_curve(F.col("x"), *CURVE).alias("y")).collect()]
    assert y == sorted(y) and y == pytest.approx(np.interp(np.arange(201) / 100 - 0.5, *CURVE).tolist())
    for bad in (([0.0], [0.0]), ([0.0, 0.0], [0.0, 1.0]), ([0.0, 1.0], [1.0, 0.0]), ([0.0, 1.0], [0.0, float("nan")])):
        with pytest.raises(ValueError):
            C.check_curve(*bad)
    with pytest.raises(Exception, match="non-finite"):
        x.select(C.must_be_finite(F.lit(float("nan")))).collect()


def test_display_never_contradicts_the_verdict(spark):
    p = spark.range(0, 1001).select((F.col("id") / 1000).alias("p"))
    out = p.select("p", C.display_percent(F.col("p"), F.col("p") >= 0.65, CURVE).alias("d")).collect()
    assert all((r.d >= 65) == (r.p >= 0.65) and 2 <= r.d <= 98 for r in out)
    assert [r.d for r in out] == sorted(r.d for r in out)


def test_fitted_curve_moves_the_best_threshold(spark):
    rng = np.random.default_rng(0)
    make = lambda n: [(int(y), float(np.clip(rng.normal(0.35 + 0.35 * y, 0.12), 0, 1))) for y in rng.integers(0, 2, n)]
    fit, held = (spark.createDataFrame(make(n), "label int, score double") for n in (4000, 2000))
    curve = L.fit_curve(fit)
    C.check_curve(curve["xs"], curve["ys"])
    assert len(curve["xs"]) <= 64
    got = M.point_metrics(held.withColumn("score", C.apply_curve(F.col("score"), curve["xs"], curve["ys"])), 0.65).first().balanced_accuracy
    assert got >= M.best_threshold(held).first().balanced_accuracy - 0.01
    with pytest.raises(ValueError):
        L.fit_platt(fit.withColumn("score", 1 - F.col("score")))


def test_leak_in_metadata_is_found(spark):
    make = lambda leak: spark.createDataFrame([(i, i % 2, f"g{i // 2}:{i % 2}", float(leak(i))) for i in range(120)], "i long, label int, grp string, x double")
    assert L.leakage_verdict(L.out_of_fold(make(lambda i: i % 2), ["x"], "grp")).first().verdict == "fail"
    assert L.fit_logistic(make(lambda i: 1.0), ["x"]) is None
    assert L.fit_logistic(make(lambda i: i).limit(5), ["x"]) is None


def test_greedy_scan_equals_the_definition(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for v in values for _ in range(3)]
    data = list(enumerate(values)) + [(900, None)]
    kept = []
    for i, v in data:
        if v is not None and all((v ^ w).bit_count() > 4 for _, w in kept):
            kept.append((i, v))
    df = spark.createDataFrame(data, "id long, bits long")
    assert sorted(r.id for r in D.greedy_dedupe(df, 4).collect()) == [i for i, _ in kept]
    pairs = {(r.a, r.b) for r in D.hamming_pairs(df.where("bits is not null"), 4).collect()}
    first = {}
    for i, v in data[:-1]:
        first.setdefault(v, i)
    nodes = sorted((i, v) for v, i in first.items())
    assert pairs == {(i, j) for i, v in nodes for j, w in nodes if i < j and (v ^ w).bit_count() <= 4}


def test_tampering_breaks_the_chain(spark):
    log = E.chain(spark.createDataFrame([(i, f"p{i}") for i in range(5)], "n long, p string"), "n", "p")
    assert E.broken_links(log, "n", "p").count() == 0
    bad = log.withColumn("p", F.when(F.col("n") == 2, "forged").otherwise(F.col("p")))
    assert [r.n for r in E.broken_links(bad, "n", "p").collect()] == [2]


def test_log_refuses_a_forged_tail(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(spark, path, "one")
    second = files.append_log(spark, path, "two")
    assert second["n"] == 1 and len(second["entry_sha256"]) == 64
    spark.createDataFrame([('{"n": 2, "payload": "x", "previous_sha256": "y", "entry_sha256": "z"}',)], "value string").write.mode("append").text(path)
    with pytest.raises(ValueError, match="tail"):
        files.append_log(spark, path, "three")


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    head = "image_id,path,label,generator,split,score,phash,degradation,cluster_id,extra"
    path.write_text("﻿" + head + '\r\na,"p,1",1,g,fit,0.5,ff,d,c,"say ""hi"""\r\nb,q,x,g,fit,nan,ff,d,,e\r\n')
    out = files.read_score_csv(spark, str(path)).orderBy("image_id").collect()
    assert (out[0].path, out[0].score, out[0].extra, out[0].score_text) == ("p,1", 0.5, 'say "hi"', "0.5") and out[1].label is None
    assert {r.rule for r in I.row_violations(files.read_score_csv(spark, str(path))).collect()} == {"label", "score", "blank_cluster"}
    path.write_text(head.replace("score", "extra") + "\n")
    with pytest.raises(ValueError, match="distinct"):
        files.read_score_csv(spark, str(path))
    path.write_text("image_id,path\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_score_csv(spark, str(path))
    path.write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_score_csv(spark, str(path))


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"records": [{"src": "a.png", "out": "b.jpg", "chain": "x", "steps": [{"op": "jpeg", "quality": 80}, {"op": "rescale", "target": 512}]}]}')
    record = files.manifest_records(spark, str(tmp_path / "m.json"))
    assert record.select(X.last_number(F.col("steps"), "jpeg", "quality").alias("q")).first().q == 80
    (tmp_path / "l.json").write_text('{"a": 1, "b": 0}')
    assert {tuple(r) for r in files.label_map(spark, str(tmp_path / "l.json")).collect()} == {("a", 1), ("b", 0)}
    np.save(tmp_path / "x.npy", np.array([1.5, 2.5]))
    assert [r.value for r in files.read_npy(spark, spark.read.format("binaryFile").load(str(tmp_path / "x.npy"))).orderBy("i").collect()] == [1.5, 2.5]
    files.write_report(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"a":"x","b":1}'
    assert "| 1 | x |" in files.markdown(spark.createDataFrame([(1, "x")], "b int, a string"), "T")


def png(pixels: np.ndarray) -> bytes:
    import struct
    import zlib

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (100, 120, 3)).astype(np.uint8)
    flat = np.full((100, 120, 3), 200, np.uint8)
    flat[40:60, 30:90] = 0
    for name, image in (("noise", noise), ("flat", flat), ("tiny", noise[:8, :8])):
        (tmp_path / f"{name}.png").write_bytes(png(image))
    (tmp_path / "broken.png").write_bytes(b"no image")
    out = {r.path.split("/")[-1]: r for r in raster.read_images(spark, str(tmp_path)).select("path", "stored_bytes", raster.extract(F.col("image"), F.col("stored_bytes")).alias("f")).select("path", "stored_bytes", "f.*").collect()}
    assert set(out) == {"noise.png", "flat.png", "tiny.png"}
    assert out["noise.png"].mean_r == pytest.approx(noise[..., 0].mean()) and out["noise.png"].mean_b == pytest.approx(noise[..., 2].mean())
    assert out["tiny.png"].spectral_ratio is None and len(out["noise.png"].fft_bands) == 7 and len(out["noise.png"].dct_bands) == 5
    assert out["flat.png"].graphic_flat > 0.95 and out["noise.png"].graphic_flat < 0.1
    assert out["noise.png"].spectral_ratio > out["flat.png"].spectral_ratio
    assert out["flat.png"].phash != out["noise.png"].phash and len(out["flat.png"].phash) == 16


def band_means(values, radius, edges):
    """Log means of rings, by loops over the cells."""
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        cells = [v for v, r in zip(values.ravel(), radius.ravel(), strict=True) if low <= r < high]
        out.append(float(np.log10(np.mean(cells) + 1e-12)) if cells else float("nan"))
    return out


def test_spectra_equal_their_definition(spark):
    rng = np.random.default_rng(5)
    luma = rng.integers(0, 256, (72, 96)).astype(float)
    h, w = luma.shape
    windowed = (luma - luma.mean()) * np.hanning(h)[:, None] * np.hanning(w)[None, :]
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    rows = np.exp(-2j * np.pi * np.outer(np.arange(h) - h // 2, np.arange(h)) / h)
    columns = np.exp(-2j * np.pi * np.outer(np.arange(w), np.arange(w) - w // 2) / w)
    size = np.abs(rows @ windowed @ columns)
    radius = np.sqrt(((y - h // 2) / (h / 2)) ** 2 + ((x - w // 2) / (w / 2)) ** 2)
    radius[h // 2, w // 2] = -1
    ratio, bands = raster.spectral(luma)
    assert bands == pytest.approx(band_means(size, radius, (0, 0.15, 0.3, 0.45, 0.6, 0.75, 1.0, 2**0.5)))
    assert ratio == pytest.approx(np.log10(size[radius >= 0.7].mean() / size[(radius >= 0) & (radius <= 0.2)].mean()))
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos(np.pi * (2 * n + 1) * k / 16) for n in range(8)] for k in range(8)])
    energy = np.mean([np.abs(basis @ luma[i : i + 8, j : j + 8] @ basis.T) for i in range(0, h, 8) for j in range(0, w, 8)], 0)
    at = np.sqrt((np.arange(8)[:, None] / 7) ** 2 + (np.arange(8)[None, :] / 7) ** 2)
    found = raster.dct_bands(luma)
    assert found[:4] == pytest.approx(band_means(energy, at, (0, 0.25, 0.5, 0.75, 1.01)))
    assert found[4] == pytest.approx(np.log10(energy[at >= 0.75].mean()) - np.log10(energy[at <= 0.25].mean()))
    on = [abs(luma[i + 1, j] - luma[i, j]) for i in range(h - 1) for j in range(w) if i % 8 == 7] + [abs(luma[i, j + 1] - luma[i, j]) for i in range(h) for j in range(w - 1) if j % 8 == 7]
    off = [abs(luma[i + 1, j] - luma[i, j]) for i in range(h - 1) for j in range(w) if i % 8 != 7] + [abs(luma[i, j + 1] - luma[i, j]) for i in range(h) for j in range(w - 1) if j % 8 != 7]
    assert raster.blockiness(luma) == pytest.approx(np.log10((np.mean(on) + 1e-6) / (np.mean(off) + 1e-6)))


def test_weak_statistics_equal_their_definition():
    rng = np.random.default_rng(6)
    rgb = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    rgb[:5] = 128
    out = raster.weak_statistics(rgb)
    assert tuple(out) == raster.WEAK
    p = rgb.reshape(-1, 3) / 255
    luma = [0.2126 * r + 0.7152 * g + 0.0722 * b for r, g, b in p]
    share = Counter(min(int(v * 32), 31) for v in luma)
    assert out["pixel_luma_entropy"] == pytest.approx(-sum(n / len(p) * np.log2(n / len(p)) for n in share.values()))
    assert out["pixel_mean_g"] == pytest.approx(np.mean([x[1] for x in p])) and out["pixel_std_b"] == pytest.approx(np.std([x[2] for x in p]))
    assert out["pixel_near_gray_fraction"] == pytest.approx(np.mean([max(x) - min(x) < 2 / 255 for x in p]))
    assert out["pixel_clipped_fraction"] == pytest.approx(np.mean([v <= 1 / 255 or v >= 254 / 255 for x in p for v in x]))
    assert out["pixel_edge_x"] == pytest.approx(np.mean([abs(luma[30 * i + j + 1] - luma[30 * i + j]) for i in range(20) for j in range(29)]))
    assert len(raster.thumbnail(rgb)) == 3072


def test_gate_fails_on_a_leak(spark):
    """A score equal to the label is told from chance, one without relation is not."""
    rows = spark.range(240).select(F.concat(F.lit("c"), F.col("id") % 80).alias("cluster_id"), ((F.col("id") % 80) % 2).cast("int").alias("label"), F.rand(3).alias("noise"))
    out = M.permutation_gate(rows.withColumn("score", F.col("label").cast("double")), samples=999, tests=5).first()
    assert out.verdict == "fail" and out.observed == 1.0 and out.p_value == pytest.approx(0.001)
    assert M.permutation_gate(rows.withColumn("score", F.col("noise")), samples=999, tests=5).first().verdict == "pass"


def test_totals_of_skewed_orders(spark):
    """One outlier does not push all rows into one range."""
    rows = spark.range(20_000).select((F.rand(1)).alias("v"), F.lit(1).alias("n")).union(spark.createDataFrame([(1e9, 1)], "v double, n int"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = O.running_totals(rows, "v", ["n"])
        assert out.agg(F.max("n_to"), F.max("n_all")).first() == (20_001, 20_001)
        assert out.where("v = 1e9").first().n_to == 20_001
        sizes = [r[0] for r in rows.repartitionByRange("v").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_near_hashes_of_clusters_that_share_a_hash(spark):
    rows = [("1", "00000000000000ff", "X"), ("2", "00000000000000ff", "Y"), ("3", "00000000000000fe", "X"), ("4", "0f00000000000000", "Z"), ("5", "0f00000000000001", "Z")]
    frame = spark.createDataFrame(rows, "image_id string, phash string, cluster_id string").selectExpr("*", "'g' generator", "'fit' split", "0 label")
    found = {(r.rule, r.key) for r in I.split_violations(frame).collect()}
    assert found == {("same_hash", "1"), ("near_duplicate", "2/3")}


def test_near_hashes_of_two_words(spark):
    rows = [("1", "00000000000000ff", "000000000000000f", "X"), ("2", "00000000000000fe", "000000000000000e", "Y"), ("3", "00000000000000fd", "f000000000000000", "Z"), ("4", "0f0f000000000000", "1", "X"), ("5", "0f0f000000000000", "1", "Y"), ("6", "0f0f000000000000", "ffff", "Z")]
    frame = spark.createDataFrame(rows, "image_id string, phash string, rest string, cluster_id string").selectExpr("*", "'g' generator", "'fit' split", "0 label")
    found = {(r.rule, r.key) for r in I.split_violations(frame, more="rest").collect()}
    assert found == {("same_hash", "4"), ("near_duplicate", "1/2")}


def test_pairs_of_two_words_equal_brute_force(spark, monkeypatch):
    """Also where one word is the same for all, and in bands that are cut again."""
    rng = random.Random(3)
    flip = lambda v, n: v ^ sum(1 << k for k in rng.sample(range(128), n))
    values = {rng.getrandbits(128) for _ in range(40)} | {rng.getrandbits(64) << 64 for _ in range(40)} | {rng.getrandbits(64) for _ in range(40)}
    values = sorted(values | {flip(v, rng.randint(1, 7)) for v in values for _ in range(3)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(v >> 64), signed(v & (1 << 64) - 1)) for i, v in enumerate(values)], "id long, bits long, more long").cache()
    for distance in (0, 1, 5):
        truth = {(i, j, (v ^ w).bit_count()) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and (v ^ w).bit_count() <= distance}
        for most in (128, 1):
            monkeypatch.setattr(D, "PAIRWISE", most)
            assert {tuple(r) for r in D.hamming_pairs(df, distance, "more").collect()} == truth


def test_hot_bands_lose_no_pair(spark):
    """More nodes than are paired within a band that all of them share."""
    rng = np.random.default_rng(8)
    values = {int(v) << 22 for v in rng.integers(0, 1 << 40, 400)}
    values |= {v ^ (1 << int(a)) ^ (1 << int(b)) for v in list(values)[:60] for a, b in [rng.integers(22, 62, 2)]}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "id long, bits long")
    truth = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(sorted(values)) for j, b in enumerate(sorted(values)) if i < j and (a ^ b).bit_count() <= 4}
    assert {tuple(r) for r in D.hamming_pairs(rows, 4).collect()} == truth and len(truth) >= 50


def test_suppressed_boxes_keep_what_only_a_suppressed_one_covers(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(150):
        x, y, s = rng.randrange(400), rng.randrange(400), rng.randrange(20, 120)
        boxes.append(("p", i, i, float(x), float(y), float(x + s), float(y + s)))
    kept = []
    for b in boxes:
        cover = lambda a: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4])) / min((a[5] - a[3]) ** 2, (b[5] - b[3]) ** 2)  # noqa: B023, E731
        if not any(cover(a) >= 0.8 for a in kept):
            kept.append(b)
    found = D.suppressed_boxes(spark.createDataFrame(boxes, "page string, id long, rank long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r.id for r in found} == {b[1] for b in kept} and len(kept) < len(boxes)


def test_parked_promotions(spark, tmp_path):
    rng = random.Random(9)
    rows = [("p", k, rng.choice(["promote", "promote", "request"]), str(rng.randrange(6)), float(rng.randrange(10))) for k in range(60)]
    src = tmp_path / "messages"
    src.mkdir()
    for k in range(3):
        pd.DataFrame(rows[20 * k : 20 * k + 20], columns=["page", "seq", "kind", "id", "priority"]).to_parquet(src / f"{k}.parquet")
    stream = W.read_files(spark, str(src), "*.parquet", "page string, seq long, kind string, id string, priority double", 1)
    held, expected = {}, []
    for page, seq, kind, i, priority in rows:
        if kind == "promote":
            held[i] = max(priority, held.get(i, priority))
            if len(held) > 3:
                del held[next(iter(held))]
        else:
            expected.append((page, seq, i, max(priority, held.pop(i, priority))))
    assert sorted(map(tuple, W.finish(W.parked_promotions(stream, 3), "parked-test", "append").collect())) == sorted(expected)


def test_text_cases(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    assert get(X.strip_markup(F.lit("a <b <i>c> d</i>  e <unclosed"))) == "a d e"
    nested = "x " + "<" * 12 + "in" + ">" * 12 + " y > z <p>w</p> " + "<" * 3 + "q>"
    assert get(X.strip_markup(F.lit(nested))) == "x y z w"
    assert get(X.slug(F.lit("Été -- 2024!"))) == "été-2024" and get(X.slug(F.lit("??"))) == "unknown"
    assert get(X.short_name(F.lit("<a>Ann</a>"))) == "Ann"
    assert get(X.same_resource(F.lit("http://www.a.com/x/"), F.lit("https://a.com/x?y=1")))
    assert get(X.before_mark(F.lit("id--deg--2"))) == "id"


def test_streams_keep_state_between_runs(spark, tmp_path):
    src, pages = tmp_path / "in", []
    src.mkdir()
    for k in range(3):
        pd.DataFrame({"page": ["p"] * 4, "url": [f"u{(k + i) % 5}" for i in range(4)], "seq": range(4 * k, 4 * k + 4)}).to_parquet(src / f"{k}.parquet")
        pages += [(f"u{(k + i) % 5}", 4 * k + i) for i in range(4)]
    stream = W.read_files(spark, str(src), "*.parquet", "page string, url string, seq long", 1)
    held = {}
    for url, seq in pages:
        held.pop(url, None)
        held[url] = seq
        held = dict(list(held.items())[-3:])
    out = W.finish(W.lru_memo(stream, 3), "memo-test").collect()
    last = {(r.url, r.seq) for r in out}
    assert set(held.items()) <= last
    counts = [r.n for r in W.finish(W.scan_counter(stream), "count-test").collect()]
    assert sorted(counts) == [4, 8, 12]


def test_admission_prefers_priority():
    q = pd.DataFrame({"seq": range(6), "url": ["a", "b", "c", "d", "e", "a"], "priority": [1.0, 1, 1, 1, 9, 2], "at": [0.0] * 6})
    out = W.admitted(q, slots=2)
    assert len(out) == 5 and out.iloc[0].url == "e" and set(out.url) == set("abcde")
    assert (out.started.diff().dropna() >= 1).all()


def test_gate_table_and_isolation(spark):
    seen = spark.createDataFrame([(5, None)], "a int, b double")
    assert {r.gate: r.passed for r in I.gate_table(seen, {"a": 5, "b": 1}).collect()} == {"a": True, "b": False}
    r = spark.createDataFrame([("x", "fit"), ("x", "eval"), ("y", "eval")], "k string, split string")
    assert I.isolation(r, F.col("split") == "fit", F.col("split") == "eval", ["k"]).first().shared == 1


@pytest.fixture
def small_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _shuffled(tmp_path, files_=1):
    """Rows of two pages in no order, dealt to files in the order of their places."""
    frame = pd.DataFrame({"seq": range(60 * files_)})
    frame["page"], frame["url"], frame["up"] = "p" + (frame["seq"] % 2).astype(str), "u" + (frame["seq"] * 7 % 11).astype(str), (frame["seq"] * 5 % 13 > 5)
    for k in range(files_):
        frame[60 * k : 60 * k + 60].sample(frac=1, random_state=k).to_parquet(tmp_path / f"{k}.parquet")
    return frame


@pytest.mark.parametrize("files_", [1, 3])
def test_latch_and_memo_take_pages_of_many_frames_in_order(spark, tmp_path, small_frames, files_):
    frame = _shuffled(tmp_path, files_)
    stream = W.read_files(spark, str(tmp_path), "*.parquet", "page string, url string, up boolean, seq long", 1)
    found = {r.page: (r.state, r.changes) for r in W.finish(W.availability(stream.withColumnRenamed("up", "available")), "latch-test", latest=["page"]).collect()}
    held = sorted((r.page, r.url, r.seq) for r in W.finish(W.lru_memo(stream, 3), "memo-test", latest=["page"]).collect())
    for page, own in frame.groupby("page"):
        now, told = "unknown", 0
        for up in own["up"]:
            then = "ready" if up else ("lost" if now in ("ready", "lost") else "missing")
            now, told = then, told + (then != now)
        assert found[page] == (now, told)
        last = own.groupby("url")["seq"].max().nlargest(3)
        assert [(u, s) for p, u, s in held if p == page] == sorted(last.items())


def test_parked_promotions_take_messages_of_many_frames_in_order(spark, tmp_path, small_frames):
    frame = _shuffled(tmp_path)
    stream = W.read_files(spark, str(tmp_path), "*.parquet", "page string, url string, up boolean, seq long")
    messages = stream.select("page", "seq", F.when(F.col("up"), "request").otherwise("promote").alias("kind"), F.col("url").alias("id"), F.col("seq").cast("double").alias("priority"))
    parked, expected = {}, []
    for r in frame.itertuples():
        key = (r.page, r.url)
        if r.up:
            expected.append((r.page, r.seq, r.url, max(float(r.seq), parked.pop(key, -1.0))))
        else:
            parked[key] = max(float(r.seq), parked.get(key, -1.0))
    # a promotion's priority is its place, so one that came later would be above its request
    assert sorted(tuple(x) for x in W.finish(W.parked_promotions(messages, 50), "parked-test", "append").collect()) == sorted(expected)


def test_fixed_text_rounds_the_exact_value(spark):
    values = [0.12345678905, 0.00000000005, 0.12345678915, 0.5, 1e-20, -0.25, 123456.123456789051, None, float("nan")]
    found = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(E.fixed(F.col("v")).alias("t")).collect()]
    assert found == [*("%.10f" % v for v in values[:-2]), "null", "NaN"]


def test_list_hash_of_many_batches(spark, small_frames):
    import hashlib

    data = [(f"k{i % 3}", f"{i:03d}", None if i == 9 else str(i * i)) for i in range(100)]
    found = {r.k: r.md5 for r in E.list_hash(spark.createDataFrame(data, "k string, i string, v string").orderBy(F.desc("i")), "k", "i", "v").collect()}
    assert found == {k: hashlib.md5(",".join(v for q, _, v in data if q == k and v is not None).encode()).hexdigest() for k in ("k0", "k1", "k2")}


def test_planes_and_thumbnails_leave_the_worker_in_small_batches(spark, monkeypatch):
    image = np.arange(6 * 5 * 3).reshape(6, 5, 3).astype(np.uint8)
    data = [(i, ("", 6, 5, 3, 16, bytearray((image + i).tobytes()))) for i in range(40)]
    frame = spark.createDataFrame(data, "i int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").coalesce(1)
    monkeypatch.setattr(raster, "MOST_VALUES", 200)  # for the direct call; workers have their own
    found = {r.i: (r.p, r.t) for r in frame.select("i", raster.normalised_planes(F.col("image")).alias("p"), raster.thumbnails(F.col("image")).alias("t")).collect()}
    for i in range(40):
        rgb = (image + i).astype(np.uint8)[..., 2::-1]
        assert np.allclose(found[i][0], ((rgb / 255 - raster.MEAN) / raster.STD).transpose(2, 0, 1).ravel(), atol=1e-12)
        assert found[i][1] == raster.thumbnail(rgb)
    images = pa.array([{"origin": "", "height": 6, "width": 5, "nChannels": 3, "mode": 16, "data": bytes(d[5])} for _, d in data])
    made = list(raster.vectors_of(iter([images]), lambda rgb: rgb.ravel().astype(float)))
    assert sum(map(len, made)) == 40 and max(len(m.values) for m in made) <= 200 + 90 and made[0][1].as_py() == (image + 1)[..., 2::-1].ravel().tolist()


def test_paired_point_takes_no_resamples_and_agrees_with_the_interval(spark, monkeypatch):
    r = rows(spark, lambda y, i: 0.2 + 0.6 * y if i % 3 else 0.5).withColumn("other", F.lit(0.7))
    whole = M.paired_delta(r, 0.65, "score", "other").drop("ci_lower", "ci_upper").first()
    monkeypatch.setattr(M, "replicates", lambda *_: pytest.fail("resampled"))
    assert M.paired_point(r, 0.65, "score", "other").first() == whole
    from scoreloom.plans.contract_queries import best_null_delta

    assert best_null_delta(spark, "/root/testdata/sf0.001").count() == 1


def test_models_of_counted_rows_equal_those_of_all_rows(spark, monkeypatch):
    data = [(f"g{i % 30}", i % 30 % 2, float(i % 4 + i % 30 % 2), float(i // 7 % 3), 0.1) for i in range(600)]
    frame = spark.createDataFrame(data, "grp string, label int, a double, b double, c double")
    seen, fit = [], L.fit_logistic
    monkeypatch.setattr(L, "fit_logistic", lambda rows_, *x, **k: seen.append(rows_.count()) or fit(rows_, *x, **k))
    one, two = ({(r.grp, r.a, r.b): r.probability for r in L.out_of_fold(frame, ["a", "b", "c"], "grp", balanced=balanced, alike=alike).collect()} for alike, balanced in ((False, False), (True, False)))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-6
    assert len(seen) == 10 and max(seen[5:]) < 120 < min(seen[:5])
