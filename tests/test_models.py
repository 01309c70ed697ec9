import math
import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import attribution as AT
from stayline.operators import boosting as BO
from stayline.operators import cohort as CO
from stayline.operators import metrics as M
from stayline.operators import models as MD
from stayline.operators.transfer import curve_draws, transfer_curve
from stayline.spec import PanelSpec
from tests.conftest import close

KEYS = ["site", "entity", "hour"]
SPEC = PanelSpec(entity="entity", label="label")


@pytest.fixture(scope="module")
def design(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        sick = i % 3 == 0
        for h in range(12):
            y = int(sick and h >= 6)
            a = rng.gauss(2.0 * y, 1)
            rows.append(("AB"[i % 2], f"e{i:02d}", h, y, a if rng.random() < 0.8 else None, rng.gauss(0, 1), None, 1 / (1 + math.exp(1 - a))))
    schema = "site string, entity string, hour int, label int, a double, b double, never double, score double"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("split", F.when(F.col("entity") < "e40", "a_train").otherwise("a_val")).cache()


def part(design, split):
    return design.filter(F.col("split") == split)


def test_scaling_uses_train_only(design):
    train = part(design, "a_train")
    scaler = MD.Standardizer.fit(train, ["a", "b", "never"])
    assert scaler.columns == ("a", "b")
    filled = [r["a"] for r in train.fillna({"a": scaler.means[0]}).collect()]
    mean = sum(filled) / len(filled)
    assert close(scaler.means[0], mean) and close(scaler.sds[0], math.sqrt(sum((x - mean) ** 2 for x in filled) / len(filled)))
    z = scaler.apply(train).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert close(z[0] + 1, 1.0) and close(z[1], 1.0)
    moved = design.withColumn("a", F.when(F.col("split") == "a_val", F.col("a") + 100).otherwise(F.col("a")))
    assert MD.Standardizer.fit(part(moved, "a_train"), ["a"]).means == scaler.means[:1]
    assert scaler.apply(train.filter("a IS NULL")).filter("a <> 0").count() == 0


def test_logistic_and_linear_attribution(design):
    train, val = part(design, "a_train"), part(design, "a_val")
    fitted = MD.fit_logistic(train, ["a", "b"], "label", 100)
    scored = fitted.score(val, [*KEYS, "label"])
    assert scored.count() == val.count()
    assert M.rank_metrics(scored.withColumn("g", F.lit(1)), ["g"]).first()["auroc"] > 0.8
    # Contributions plus intercept give back the margin of every row.
    weights = MD.linear_weights(fitted)
    local = AT.local_attribution(val, fitted.prepare, weights, KEYS)
    margins = local.groupBy(*KEYS).agg(F.sum("contribution").alias("m")).join(scored, KEYS)
    for r in margins.collect():
        assert close(1 / (1 + math.exp(-(r["m"] + fitted.model.intercept))), r["score"], 1e-6)
    top = AT.global_attribution(val, fitted.prepare, weights, ["site"]).filter("rank = 1").collect()
    assert {r["feature"] for r in top} == {"a"}


def test_boosting_search_and_importance(design):
    train, val = part(design, "a_train"), part(design, "a_val")
    tried = [BO.BoostParams(0.1, 15, 20, 4), BO.BoostParams(0.1, 15, 20, 4), BO.BoostParams(0.05, 15, 100, 2)]
    best, rows, fitted = MD.search(train, val, ["a", "b", "never"], "label", tried)
    assert best == tried[0] and rows[0]["auprc"] == rows[1]["auprc"] and len(fitted[tried[2]].trees) == 2
    model = fitted[tried[0]]
    assert model.columns == ("a", "b")
    gain = model.split_gain()
    drop = {r["feature"]: r["importance"] for r in MD.permutation_importance(model, val, KEYS, "label").collect()}
    assert gain["a"] > gain["b"] and drop["a"] > drop["b"] and set(drop) == {"a", "b"}
    assert len(BO.grid()) == 18 and {p.rounds for p in BO.grid()} == {600}


def test_rows_of_a_pair_come_from_the_design(design):
    moved = MD.paired(design, ["a", "b"], KEYS)
    assert moved.drop("_other").exceptAll(design).count() == 0 and moved.count() == design.count()
    assert moved.select("_other.*").exceptAll(design.select("a", "b")).count() == 0


def test_one_join_for_any_number_of_columns(design):
    def joins(columns):
        plan = MD.paired(design, columns, KEYS)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join ")

    assert joins(["a"]) == joins(["a", "b", "never", "score"])


def test_save_and_load(design, tmp_path):
    fitted = MD.fit_logistic(part(design, "a_train"), ["b", "a"], "label", 20)
    MD.save(fitted, str(tmp_path / "m"))
    back = MD.load(str(tmp_path / "m"))
    assert back.prepare == fitted.prepare
    val = part(design, "a_val")
    assert back.score(val, KEYS).exceptAll(fitted.score(val, KEYS)).count() == 0


def test_training_sets(design):
    renamed = design.withColumn("split", F.when(F.col("site") == "A", "a_train").otherwise("b_train"))
    n = {k: v.count() for k, v in MD.training_sets(renamed).items()}
    assert n["A"] + n["B"] == n["A+B"] == design.count()


def test_transfer_curve(design):
    adapt = design.filter("entity < 'e40'").drop("split")
    evaluation = design.filter("entity >= 'e40'").drop("split")
    params = BO.BoostParams(rounds=2)
    got = transfer_curve(adapt, evaluation, SPEC, ["a", "b"], 0.5, n_values=(0, 6, 70), draws=2, params=params)
    rows = {(r["n"], r["draw"], r["mode"]): (r["auprc"], r["utility"]) for r in got.collect()}
    assert len(rows) == 12
    assert len({rows[(0, d, m)] for d in (0, 1) for m in ("recalib", "finetune")}) == 1
    base = M.evaluate(evaluation.withColumn("g", F.lit(1)), ["g"], F.lit(0.5), SPEC.key).first()
    assert rows[(0, 0, "recalib")] == (base["auprc"], base["utility"])
    assert rows[(6, 0, "finetune")] != rows[(6, 1, "finetune")] != rows[(0, 0, "finetune")]
    assert {v for k, v in rows.items() if k[0] == 70} == {(None, None)}
    assert {r["n_drawn"] for r in got.filter("n = 70").collect()} == {40} and {r["n_drawn"] for r in got.filter("n = 6").collect()} == {6}
    with pytest.raises(AssertionError):
        transfer_curve(design.drop("split"), evaluation, SPEC, ["a"], 0.5, n_values=(40,), draws=1, params=params)


def test_draws_of_a_curve_are_the_single_draws(design):
    got = curve_draws(design, SPEC, (3, 10), 2)
    for n, d in ((3, 0), (3, 1), (10, 0), (10, 1)):
        one = CO.draw_entities(design, SPEC, n, CO.draw_seed(n, d))
        mine = got.where((F.col("n") == n) & (F.col("draw") == d)).select(*SPEC.key)
        assert mine.count() == n and mine.exceptAll(one).count() == 0


def test_first_cases(design):
    got = {r["case"]: r for r in AT.first_cases(design, KEYS, 0.5).collect()}
    hits = design.filter("score >= 0.5").orderBy(*KEYS)
    first = hits.filter("label = 1").first()
    assert [got["true_positive"][k] for k in KEYS] == [first[k] for k in KEYS]


def test_registered_curve_is_the_whole_study(monkeypatch, spark):
    """Sizes, draws and rounds are the study's."""
    from stayline.plans import q_compare
    from stayline.spec import CONFIG
    from tests.conftest import TESTDATA

    called = {}
    monkeypatch.setattr(q_compare, "transfer_curve", lambda *rest, **named: called.update(named))
    q_compare.g7(spark, TESTDATA)
    assert called["modes"] == ("recalib", "finetune")
    assert called.get("n_values", CONFIG.transfer_n) == CONFIG.transfer_n
    assert called.get("draws", CONFIG.transfer_draws) == CONFIG.transfer_draws
    assert "params" not in called and transfer_curve.__defaults__[2].rounds == CONFIG.fine_tune_rounds


def test_last_rows_are_found_without_a_sort(spark):
    """The row of the last hour with all its columns, also text; a column that nobody reads is left out."""
    from stayline.plans.q_models import last_rows

    rows = spark.createDataFrame(
        [("A", i % 7, h, None if h % 5 == 4 else h / 3, f"s{h}") for i in range(14) for h in range(i // 7, 20, 2)],
        "site string, entity int, hour int, x double, split string",
    ).repartition(3)
    got = {r["entity"]: tuple(r) for r in last_rows(rows, ["site", "entity"]).collect()}
    assert got == {e: ("A", e, 19, None, "s19") for e in range(7)}
    plan = last_rows(rows, ["site", "entity"]).drop("split")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "split" not in plan.split("Scan ExistingRDD")[0].replace("drop", "")


def test_rows_are_not_shuffled_by_model_for_their_threshold(spark):
    """There are as few models as thresholds, so a shuffle by model has as few tasks."""
    from stayline.operators.study import study_matrix

    rows = [
        (m, s, site, site + str(i), h, int(h > 3), (h + i) / 10)
        for m in ("A", "B", "A+B") for s, site in (("a_val", "A"), ("b_eval", "B")) for i in range(3) for h in range(6)
    ]
    scored = spark.createDataFrame(rows, "model string, split string, site string, entity string, hour int, label int, score double")
    plan = study_matrix(scored, SPEC)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line and "model" in line]
    assert any("rightHint=(strategy=broadcast)" in line for line in joined)


def test_rows_of_the_curve_are_not_broadcast(spark, design):
    """Hours are made from few readings, and stored ones take few bytes; only the draws go to the driver."""
    from stayline.operators import transfer as TR
    from stayline.plans import q_compare
    from tests.conftest import TESTDATA
    from tests.test_features import broadcast_generators

    assert broadcast_generators(q_compare.curve_rows(spark, TESTDATA)) == []
    drawn = curve_draws(design, SPEC, (3, 10), 2)
    plan = TR.of_draws(design, drawn, SPEC)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_recalibration_makes_rows_of_draws_after_its_joins(spark, design):
    """Rows are found their calibrated scores once, not once a draw; a null score stays a row."""
    from stayline.operators import transfer as TR

    adapt, evaluation = design.filter("site = 'A'"), design.filter("site = 'B'")
    drawn = curve_draws(adapt, SPEC, (3,), 2)
    one = evaluation.limit(1).withColumn("score", F.lit(None).cast("double"))
    asked = M.with_onset(evaluation.unionByName(one), SPEC.key, name=TR.ONSET)
    got = TR.recalibrated(adapt, asked, drawn, SPEC, [(3, 0), (3, 1)])
    n = evaluation.count() + 1
    assert {(r["n"], r["draw"]): r["count"] for r in got.groupBy("n", "draw").count().collect()} == {(3, 0): n, (3, 1): n}
    assert got.filter("score IS NULL").count() == 2
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(line for line in top if "Join" in line or "Generate" in line).strip(" :+-").startswith("Generate")
    assert "Window" not in "".join(top)  # the calibration is stored: three readers would plan and run it three times
