import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stayline.operators import compare as C
from stayline.operators import metrics as M
from stayline.spec import PanelSpec
from tests.conftest import close

SCHEMA = "site string, entity string, hour int, label int, score double"


def stays(spark, *items):
    """(entity, labels, scores) stays."""
    return spark.createDataFrame(
        [("A", e, h, y, float(s)) for e, ys, ss in items for h, (y, s) in enumerate(zip(ys, ss))], SCHEMA
    )


def plain_utility(labels, preds):
    """Published closed form, row by row."""
    onset = labels.index(1) if 1 in labels else None
    total = 0.0
    for h, p in enumerate(preds):
        if onset is None:
            total += -0.05 * p
            continue
        dt = h - (onset + 6)
        if dt <= -6:
            total += max((dt + 12) / 6, -0.05) if p else 0.0
        elif dt <= 3:
            total += (3 - dt) / 9 if p else -2 * (dt + 6) / 9
    return total


def plain_normalised(items, t):
    seen = best = idle = 0.0
    for _, ys, ss in items:
        seen += plain_utility(ys, [int(s >= t) for s in ss])
        idle += plain_utility(ys, [0] * len(ys))
        win = [0] * len(ys)
        if 1 in ys:
            ts = ys.index(1) + 6
            for h in range(max(0, ts - 12), min(ts + 4, len(ys))):
                win[h] = 1
        best += plain_utility(ys, win)
    return (seen - idle) / (best - idle)


def random_items(n, seed):
    rng = random.Random(seed)
    items = []
    for i in range(n):
        size = rng.randint(1, 40)
        onset = rng.choice([None, rng.randint(0, size)])
        ys = [int(onset is not None and h >= onset) for h in range(size)]
        items.append((f"e{i}", ys, [round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 2) for y in ys]))
    return items


def test_pinned_utility(spark):
    rows = stays(spark, ("a", [0, 0, 0, 0, 1, 1], [0, 0, 1, 1, 1, 1]))
    got = M.row_utility(rows, ("site", "entity"), F.lit(0.5)).agg(F.sum("utility")).first()[0]
    assert close(got, 3.388888888888889, 1e-12)


def test_separable_scores(spark):
    rows = stays(spark, ("a", [0, 0, 0, 0, 1, 1], [0.3, 0.4, 0.6, 0.7, 0.8, 0.8]))
    got = M.rank_metrics(rows.withColumn("g", F.lit(1)), ["g"]).first()
    assert (got["auroc"], got["auprc"]) == (1.0, 1.0)


def test_ranks_against_pairs(spark):
    items = random_items(30, 11)
    ys = [y for _, a, _ in items for y in a]
    ss = [s for _, _, b in items for s in b]
    pos, neg = [s for s, y in zip(ss, ys) if y], [s for s, y in zip(ss, ys) if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(ss), reverse=True):
        hit = [y for s, y in zip(ss, ys) if s >= t]
        ap += sum(y for s, y in zip(ss, ys) if s == t) / len(pos) * sum(hit) / len(hit)
    got = M.evaluate(stays(spark, *items), [], F.lit(0.5)).first()
    assert close(got["auroc"], auroc) and close(got["auprc"], ap)
    assert got["n_patients"] == 30 and got["n_hours"] == len(ys)


def test_record_against_plain_code(spark):
    items = random_items(25, 3)
    rows = stays(spark, *items)
    got = M.evaluate(rows, [], F.lit(0.6)).first()
    assert close(got["utility"], plain_normalised(items, 0.6))
    pairs = [(y, int(s >= 0.6)) for _, a, b in items for y, s in zip(a, b)]
    tp = sum(y and p for y, p in pairs)
    wrong = sum(y != p for y, p in pairs)
    assert close(got["accuracy"], 1 - wrong / len(pairs))
    assert close(got["f_measure"], 2 * tp / (2 * tp + wrong))
    assert close(got["alerts_per_100_days"], 2400 * sum(p for _, p in pairs) / len(pairs))


def test_inaction_scores_zero_and_one_class_is_null(spark):
    never = M.evaluate(stays(spark, ("a", [0, 0, 1, 1], [0.1] * 4)), [], F.lit(0.5)).first()
    assert never["utility"] == 0.0
    flat = M.evaluate(stays(spark, ("a", [0, 0], [0.1, 0.9])), [], F.lit(0.5)).first()
    assert flat["auroc"] is None and flat["auprc"] is None and flat["utility"] is None


def test_guard(spark):
    with pytest.raises(ValueError, match="no rows"):
        M.require_scored(stays(spark, ("a", [0], [0.1])).filter("hour > 5"))
    with pytest.raises(ValueError, match="0/1 label"):
        M.require_scored(stays(spark, ("a", [2], [0.1])))


def test_sweep_equals_brute_force(spark):
    items = random_items(12, 9)
    rows = stays(spark, *items)
    got = {round(r["threshold"] * 100): r["utility"] for r in M.sweep(rows, []).collect()}
    assert sorted(got) == list(range(1, 100))
    want = {k: plain_normalised(items, k / 100) for k in range(1, 100)}
    assert all(close(got[k], want[k]) for k in want)
    top = max(round(u, 9) for u in want.values())
    first = min(k for k, u in want.items() if round(u, 9) == top)
    assert M.freeze_threshold(rows) == first / 100


def test_no_threshold_without_utility(spark):
    with pytest.raises(ValueError):
        M.freeze_threshold(stays(spark, ("a", [0, 0], [0.1, 0.2])))


def test_reliability_edges(spark):
    rows = stays(spark, ("a", [0, 1, 1], [0.0, 0.1, 1.0])).withColumn("g", F.lit(1))
    bins = {r["bin"]: r for r in M.reliability(rows, ["g"]).collect()}
    assert len(bins) == 10 and bins["0.90-1.00"]["n"] == 1 and bins["0.10-0.20"]["n"] == 1
    assert bins["0.40-0.50"]["n"] == 0 and bins["0.40-0.50"]["mean_prediction"] is None


def test_subgroups(spark):
    rng = random.Random(1)
    rows = [
        ("A", f"e{i % 400}", i // 400, int(s > 0.9), s, (i % 400) % 2, 30 if i % 400 < 4 else 40 + (i % 400) % 50, None, 1)
        for i, s in enumerate(rng.random() for _ in range(4000))
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", gender int, age int, unit1 int, unit2 int")
    spec = PanelSpec(age="age", gender="gender", units=("unit1", "unit2"))
    got = {r["group"]: r for r in M.subgroup_metrics(df, M.subgroup_labels(spec)).collect()}
    assert "Unit1=1" not in got and got["Unit2=1"]["n_hours"] == 4000
    assert got["age <40"]["suppressed"] == 1 and got["age <40"]["auroc"] is None
    assert sum(r["n_hours"] for g, r in got.items() if g.startswith("age")) == 4000
    assert got["sex=0"]["auroc"] == 1.0


def test_drift_textbook(spark):
    rows = [("A", float(x)) for x in (0, 1, 3)] + [("B", float(x)) for x in (5, 6, 8)]
    df = spark.createDataFrame([(s, x, x if s == "A" else None) for s, x in rows], "s string, x double, one double")
    got = {r["feature"]: r for r in C.ranked_drift(C.drift(df, "s", "A", "B", ["x", "one"])).collect()}
    assert close(got["x"]["distance"], 5.0) and got["one"]["distance"] is None
    assert (got["x"]["drift_rank"], got["one"]["drift_rank"]) == (1, 2)


def test_null_group_is_scored(spark):
    rows = [(g, "s", e, h, int(h > 3 and e == "a"), h / 9) for g in (None, "x") for e in ("a", "b") for h in range(8)]
    scored = spark.createDataFrame(rows, "g string, site string, entity string, hour int, label int, score double")
    for got in (M.evaluate(scored, ["g"], F.lit(0.5)), M.rank_metrics(scored, ["g"])):
        by = {r["g"]: tuple(r)[1:] for r in got.collect()}
        assert set(by) == {None, "x"} and by[None] == by["x"]
    assert {r["g"] for r in M.best_threshold(M.sweep(scored, ["g"]), ["g"]).collect()} == {None, "x"}
    null_site = scored.withColumn("site", F.lit(None).cast("string"))
    assert M.evaluate(null_site, ["g"], F.lit(0.5)).select("n_hours", "utility").collect() == M.evaluate(scored, ["g"], F.lit(0.5)).select("n_hours", "utility").collect()


def test_evaluation_refuses_unusable_rows(spark):
    columns = "site string, entity string, hour int, label int, score double"
    for label, score in ((None, 0.5), (2, 0.5), (1, None)):
        bad = spark.createDataFrame([("s", "e", 0, 1, 0.5), ("s", "e", 1, label, score)], columns)
        with pytest.raises(PySparkException, match="without a 0/1 label"):
            M.evaluate(bad, [], F.lit(0.5)).collect()
    with pytest.raises(PySparkException, match="no rows"):
        M.evaluate(spark.createDataFrame([], columns), ["site"], F.lit(0.5)).collect()


def test_the_aggregate_of_onsets_is_shuffled_once(spark):
    """Nullable keys too: the join reads the partitioning of the aggregate under it."""
    rows = stays(spark, ("a", [0, 1], [0.1, 0.9])).repartition(3)
    assert any(f.nullable for f in rows.select("site", "entity").schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.with_utility(rows, ["site", "entity"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert plan.count("Exchange hashpartitioning") == 2
