"""Rules over configurations, audits and shipped artifacts, as frames of violations, and what binds evidence together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.evidence import content_hash
from scoreloom.operators.integrity import gate_table, isolation
from scoreloom.operators.metrics import point_metrics

#: The decision threshold, scenarios, clusters a class needs, and the area at which an audit fails.
THRESHOLD, SCENARIOS, POWER_FLOOR, FAIL_AUC, SHIP_ACCURACY = 0.65, ("clean", "web-realistic", "unseen-generator"), 100, 0.70, 0.75
#: Fixed values of a shipped model.
SHIPPED = {"precision": "dynamic-int8", "mode": "official-center", "aggregation": "single-crop", "column": "score_official_browser", "runtime": "official-center-resize440-crop384"}

CONFIG_SCHEMA = (
    "formatVersion int, id string, scenario string, split string, scoreColumn string, threshold double, "
    "gates struct<minBalancedAccuracy:double,requireCiLowerBound:boolean,minImagesPerClass:int,minClustersPerClass:int,minAuditCoverage:double,requiredDegradations:map<string,struct<minImagesPerClass:int>>>, "
    "bootstrap struct<samples:int,confidence:double,seed:bigint>"
)
#: Fields in the order of their names, so that writing the parsed document gives its canonical text.
AUDIT_SCHEMA = (
    "config struct<featureSet:string,pixelFeaturesIncluded:boolean>, contentSha256 string, coverage struct<failures:array<string>>, formatVersion int, "
    "inputs struct<degradationManifestSha256:string>, result struct<groupedCrossValidatedRocAuc:double>, status string, thresholds struct<failRocAuc:double>, type string"
)


def _broken(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules.items())), lambda x: x.isNotNull())


def config_violations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, rule)`` for each rule that a JSON evaluation config breaks; one that cannot be read lacks every field."""
    c = lambda f: F.col(f"_c.{f}")
    gate = lambda f: c(f"gates.{f}")
    outside = lambda f: ~gate(f).between(0.0, 1.0)
    required = F.coalesce(gate("requiredDegradations"), F.create_map().cast("map<string,struct<minImagesPerClass:int>>"))
    rules = {
        "missing": F.exists(F.array(*(c(f).isNull() for f in ("formatVersion", "id", "scenario", "split", "scoreColumn", "gates", "bootstrap"))), lambda x: x),
        "version": c("formatVersion") != 1,
        "threshold": F.coalesce(c("threshold"), F.lit(THRESHOLD)) != THRESHOLD,
        "scenario": ~c("scenario").isin(*SCENARIOS),
        "min_images": gate("minImagesPerClass") <= 0,
        "power_floor": gate("minClustersPerClass") < POWER_FLOOR,
        "audit_coverage": outside("minAuditCoverage"),
        "accuracy": outside("minBalancedAccuracy"),
        "degradations": F.exists(F.map_entries(required), lambda e: (e["key"] == "") | (F.coalesce(e["value"]["minImagesPerClass"], F.lit(0)) <= 0)),
    }
    return texts.withColumn("_c", F.from_json(text, CONFIG_SCHEMA)).select(key, F.explode(_broken(rules)).alias("rule"))


def unsigned_hash(parsed: Column) -> Column:
    """Hash of the canonical text of a parsed document without its own hash."""
    return F.sha2(F.to_json(parsed.dropFields("contentSha256")), 256)


def audit_verdicts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, verdict)``: ``accepted``, or the first reason against a JSON leakage audit.

    An audit of the construction features alone is accepted with its status; a
    full one must include pixel features, have no open failures and an area
    below its own limit.
    """
    a = lambda f: F.col(f"_a.{f}")
    yes = lambda test: F.coalesce(test, F.lit(False))
    verdict = (
        F.when(~yes((a("formatVersion") == 1) & (a("type") == "dataset-leakage-audit")), "unsupported")
        .when(~yes(a("contentSha256") == unsigned_hash(F.col("_a"))), "hash")
        .when(~yes(a("status").isin("pass", "warn")), "status")
        .when(yes(a("config.featureSet") == "construction"), "accepted")
        .when(~yes(a("config.pixelFeaturesIncluded")), "no_pixels")
        .when(F.coalesce(F.size(a("coverage.failures")), F.lit(0)) > 0, "failures")
        .when(F.coalesce(a("result.groupedCrossValidatedRocAuc"), F.lit(1.0)) >= F.coalesce(a("thresholds.failRocAuc"), F.lit(FAIL_AUC)), "area")
        .otherwise("accepted")
    )
    return texts.withColumn("_a", F.from_json(text, AUDIT_SCHEMA)).select(key, verdict.alias("verdict"))


def shipping_violations(models: DataFrame, key: str) -> DataFrame:
    """``(key, rule)`` for each rule that a model entry and its curve break.

    ``models`` has ``model(precision, file, mode, aggregation, sha256, url, curve_id, input_column)`` and ``curve(id, xs,
    ys, input_column, preprocessing, aggregation, model_sha256, status, gate_passed, held_out_accuracy, audits,
    rows_sha256, eval_sha256, config_sha256, provenance, owner, comparison, battery)`` as structs. Evidence is asked
    for only of a model with a URL.
    """
    m, c = (lambda f, p=p: F.col(f"{p}.{f}") for p in ("model", "curve"))
    rises = lambda a, least: F.size(F.filter(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: y - x), least)) == F.size(a) - 1
    curve = (F.size(c("xs")) == F.size(c("ys"))) & (F.size(c("xs")) >= 2) & rises(c("xs"), lambda d: d > 0) & rises(c("ys"), lambda d: d >= 0)
    shipped = F.coalesce(m("url"), F.lit("")) != ""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    evidence = {
        "quarantined": c("status") != "validated",
        "accuracy": ~c("gate_passed") | (c("held_out_accuracy") < SHIP_ACCURACY),
        "no_audit": F.size(c("audits")) < 1,
        "failed_audit": F.exists(c("audits"), lambda x: (x["status"] != "pass") | (x["auc"] >= FAIL_AUC)),
        "hashes": blank(c("rows_sha256")) | blank(c("eval_sha256")) | blank(c("config_sha256")),
        "provenance": (c("provenance") != "pass") | blank(c("owner")),
        "comparison": c("comparison") != "pass",
        "battery": c("battery") != "pass",
    }
    rules = {
        "precision": m("precision") != SHIPPED["precision"],
        "file": ~m("file").endswith("-int8.onnx"),
        "preprocessing": m("mode") != SHIPPED["mode"],
        "aggregation": m("aggregation") != SHIPPED["aggregation"],
        "curve": ~curve,
        "input_column": c("input_column") != SHIPPED["column"],
        "runtime": (c("preprocessing") != SHIPPED["runtime"]) | (c("aggregation") != SHIPPED["aggregation"]),
        "model_hash": c("model_sha256") != m("sha256"),
        "curve_id": (m("curve_id") != c("id")) | (m("input_column") != c("input_column")),
    } | {k: shipped & F.coalesce(v, F.lit(True)) for k, v in evidence.items()}
    return models.select(key, F.explode(_broken(rules)).alias("rule"))


def refit_gates(rows: DataFrame, audited: DataFrame, least: int, floor: float, score: str = "score", image: str = "image_id") -> DataFrame:
    """``(gate, observed, least, passed)`` of a refit: separate selections, enough rows by class, full audit coverage, accuracy held out.

    ``rows`` has a ``split`` of calibration or eval. Isolation and coverage are
    given as the number of faults below zero, so that every gate is a minimum.
    """
    chosen = rows.where(F.col("split").isin("calibration", "eval"))
    shared = isolation(chosen, F.col("split") == "calibration", F.col("split") == "eval", ["cluster_id", "generator"])
    shared = shared.groupBy().pivot("key", ["cluster_id", "generator"]).agg(-F.first("shared")).withColumnsRenamed({"cluster_id": "isolated_clusters", "generator": "isolated_generators"})
    n = lambda split, k: F.count_if((F.col("split") == split) & (F.col("label") == k)).alias(f"{split}_{k}")
    counts = chosen.agg(*(n(s, k) for s in ("calibration", "eval") for k in (0, 1)), (1 - F.countDistinct("model_sha256")).alias("one_model"))
    missing = chosen.select(image).distinct().join(audited.select(image).distinct(), image, "left_anti").agg((-F.count("*")).alias("audited_images"))
    held = point_metrics(chosen.where("split = 'eval'"), THRESHOLD, score).select(F.col("balanced_accuracy").alias("held_out_accuracy"))
    seen = counts.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(held))
    limits = {"isolated_clusters": 0, "isolated_generators": 0, **{f"{s}_{k}": least for s in ("calibration", "eval") for k in (0, 1)}, "one_model": 0, "audited_images": 0, "held_out_accuracy": floor}
    return gate_table(seen, limits)


def bind_evidence(parts: dict[str, Column]) -> Column:
    """The hash over the named hashes of a report's inputs: a change of any one of them changes it."""
    return content_hash(parts)


def assignment_violations(counts: DataFrame, assignment: DataFrame, group: str = "grp", splits: Sequence[str] = ("fit", "calibration", "eval")) -> DataFrame:
    """``(rule, key)`` where an explicit assignment does not name every observed group exactly once with a known split."""
    named = assignment.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("split").isin(*splits), F.lit(False))).alias("bad"))
    both = counts.select(group, F.lit(True).alias("seen")).distinct().join(named, group, "full")
    rules = {"missing": F.col("n").isNull(), "unknown": F.col("seen").isNull(), "twice": F.coalesce(F.col("n") > 1, F.lit(False)), "split": F.coalesce(F.col("bad") > 0, F.lit(False))}
    return both.select(F.explode(_broken(rules)).alias("rule"), F.col(group).alias("key"))


def selection(split: str, generators: Sequence[str] | None) -> Column:
    """Rows of a list of generators, if one is given, and else of a split."""
    return F.coalesce(F.col("generator").isin(*generators) if generators else F.col("split") == split, F.lit(False))


def selection_violations(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """``(rule, n)``: selections that are empty, lack a class, or overlap."""
    seen = rows.agg(
        *(F.count_if(side & (F.col("label") == k)).alias(f"{name}_{k}") for name, side in (("left", left), ("right", right)) for k in (0, 1)),
        F.count_if(left & right).alias("both"),
    )
    rules = {f"{name}_lacks_{k}": F.col(f"{name}_{k}") == 0 for name in ("left", "right") for k in (0, 1)} | {"overlap": F.col("both") > 0}
    return seen.select(F.explode(_broken(rules)).alias("rule"), F.col("both").alias("n"))


def image_refusal(declared: Column, width: Column, height: Column, most_pixels: int = 100_000_000) -> Column:
    """Why an image is not taken: its declared type is another one's, or it decodes to too many pixels; null if it is."""
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), ";"), 1)))
    other = (kind != "") & ~kind.startswith("image/") & (kind != "application/octet-stream")
    return F.when(other, "not_an_image").when(width.cast("long") * height > most_pixels, "too_many_pixels")


def stored_flag(live: Column, stored: Column, fallback: bool) -> Column:
    """A flag as it holds after a late read: a live value wins, a stored one is kept also if false, and only a missing one is the fallback."""
    return F.coalesce(live, stored, F.lit(fallback))
