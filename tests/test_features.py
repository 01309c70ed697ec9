import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import features as FT
from stayline.operators.grid import dense_grid
from stayline.spec import STATISTICS, PanelSpec
from tests.conftest import TESTDATA, close

ONE = PanelSpec(entity="e", clock="clock", label="y", variables=("x",), model_static=("clock",))
SCHEMA = "site string, e string, hour int, x double, clock int, y int"


def panel(spark, values, entity="a"):
    rows = [("A", entity, h, None if v is None else float(v), h + 1, 0) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def by_hour(df, column):
    return [r[column] for r in df.orderBy("hour").collect()]


def test_hand_arithmetic(spark):
    long = FT.window_features_long(panel(spark, [1, 2, None, 4, 5]), ONE, (3,))
    assert by_hour(long, "min_3") == [1, 1, 1, 2, 4]
    assert by_hour(long, "max_3") == [1, 2, 2, 4, 5]
    assert by_hour(long, "mean_3") == [1, 1.5, 1.5, 3, 4.5]
    assert by_hour(long, "last_3") == [1, 2, 2, 4, 5]
    assert [close(a, b) for a, b in zip(by_hour(long, "slope_3"), [None, 1, 1, 1, 1])] == [True] * 5


def test_carry_forward_and_recency(spark):
    got = FT.recency(panel(spark, [70, None, None, 75, None]), ONE)
    assert by_hour(got, "x_last") == [70, 70, 70, 75, 75]
    assert by_hour(got, "x_hours_since_measured") == [0, 1, 2, 0, 1]
    late = FT.recency(panel(spark, [None, 3, None, None]), ONE)
    assert by_hour(late, "x_hours_since_measured") == [None, 0, 1, 2]
    assert by_hour(late, "x_missing") == [1, 0, 1, 1]


def test_long_stays_cross_blocks(spark):
    """1300 hours span three blocks; every value equals a plain computation."""
    rng = random.Random(3)
    xs = [round(rng.random() * 50, 2) if rng.random() < 0.05 or h == 2 else None for h in range(1300)]
    xs[3:600] = [None] * 597  # nothing measured across a block edge
    got = {r["hour"]: r for r in FT.window_features_long(panel(spark, xs), ONE, (6, 24)).collect()}
    last = {r["hour"]: r for r in FT.recency(panel(spark, xs), ONE).collect()}
    assert len(got) == len(last) == 1300
    seen = None
    for h, x in enumerate(xs):
        seen = h if x is not None else seen
        assert got[h]["hours_since_measured"] == (None if seen is None else h - seen)
        assert last[h]["x_last"] == (None if seen is None else xs[seen])
        for w in (6, 24):
            inside = [v for v in xs[max(0, h - w + 1) : h + 1] if v is not None]
            assert got[h][f"min_{w}"] == (min(inside) if inside else None)
            assert got[h][f"last_{w}"] == (inside[-1] if inside else None)
            assert close(got[h][f"mean_{w}"], sum(inside) / len(inside) if inside else None)


def test_future_rows_never_matter(spark, cohort):
    spec = PanelSpec()
    one = cohort.filter("patient_id = 'p000002'")
    changed = one.select(
        *[F.when(F.col("hour") >= 20, F.lit(999.9)).otherwise(F.col(c)).alias(c) if c in spec.variables else c for c in one.columns]
    )
    past = [FT.feature_arrays(d, spec).filter("hour < 20").orderBy("hour").collect() for d in (one, changed)]
    assert past[0] == past[1] and len(past[0]) == 20


def test_row_equals_prefix(spark, cohort):
    """The features of hour h are those of the record cut after h."""
    one = cohort.filter("patient_id = 'p000013'")
    whole = {r["hour"]: r["features"] for r in FT.feature_arrays(one, PanelSpec()).collect()}
    for h in (0, 7, 40):
        prefix = FT.feature_arrays(one.filter(F.col("hour") <= h), PanelSpec())
        assert prefix.filter(F.col("hour") == h).first()["features"] == whole[h]


def test_frozen_columns(spark, cohort):
    spec = PanelSpec()
    names = spec.window_feature_columns()
    assert len(names) == len(set(names)) == 582
    assert names[:2] == ["HR_missing", "HR_hours_since_measured"] and names[-1] == "ICULOS"
    assert not any(c.startswith("Unit") for c in names)
    wide = FT.window_features(cohort.filter("patient_id = 'p000003'"), spec)
    assert wide.columns == [*spec.side, *names]
    long = FT.window_features_long(cohort.filter("patient_id = 'p000003'"), spec)
    want = {(r["hour"], r["variable"]): r for r in long.collect()}
    for r in wide.collect():
        for v in ("HR", "WBC"):
            for s in STATISTICS:
                assert r[f"{v}_{s}_12"] == want[(r["hour"], v)][f"{s}_12"]


def test_one_shuffle_of_the_wide_rows(spark, cohort, tmp_path):
    cohort.write.parquet(str(tmp_path / "c"))
    long = FT.window_features_long(spark.read.parquet(str(tmp_path / "c")), PanelSpec(), with_recency=False)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_unobservable_columns(spark, cohort):
    train = FT.minimal_features(cohort.filter("patient_id = 'p000007'"), PanelSpec())
    kept = FT.observable_columns(train, PanelSpec().minimal_feature_columns())
    assert "Lactate_last" not in kept and "Lactate_missing" in kept and "HR_last" in kept


def test_dense_grid(spark):
    rows = spark.createDataFrame([("a", 10, 1.0), ("a", 13, 2.0), ("b", 5, 3.0)], "e string, t long, x double")
    got = sorted((r["e"], r["hour"], r["x"]) for r in dense_grid(rows, ["e"], "t").collect())
    assert got == [("a", 0, 1.0), ("a", 1, None), ("a", 2, None), ("a", 3, 2.0), ("b", 0, 3.0)]
    span = spark.createDataFrame([("a", 0, 1.0), ("a", 9999, 2.0)], "e string, t long, x double")
    assert dense_grid(span, ["e"], "t").count() == 10_000


def test_wide_and_long_features_agree(cohort):
    """Either layout gives the same values, over block borders, for stays with unmeasured variables as well."""
    spec = PanelSpec(variables=("HR", "Lactate", "Temp"))
    wide = FT.window_features(cohort, spec, wide_up_to=3)
    rows = FT.window_features(cohort, spec, wide_up_to=0)
    assert wide.columns == rows.columns
    side = [*spec.side]
    shown = lambda d: d.select(*side, *[F.round(c, 9).alias(c) for c in d.columns if c not in side])
    a, b = ({tuple(r) for r in shown(d).collect()} for d in (wide, rows))
    assert a == b and len(a) == cohort.count()
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" not in plan and "collect_list" not in plan


def broadcast_generators(df):
    """Generators of the finished plan whose rows go to the driver with no shuffle in between."""
    df.collect()
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        name = line.lstrip(" :+-*|")
        depth = len(line) - len(name)
        if inside is not None and (depth <= inside or name.startswith("Exchange")):
            inside = None
        if name.startswith("BroadcastExchange"):
            inside = depth
        elif inside is not None and "Generate" in name:
            found.append(name)
    return found


def test_generated_hours_are_not_broadcast(spark):
    """Spark takes the hours for as few as the rows they are made from."""
    from stayline.operators.cohort import entity_hours
    from stayline.operators.metrics import onsets, with_utility
    from stayline.plans import bindings as B

    panel = B.cohort(spark, TESTDATA)
    assert broadcast_generators(entity_hours(panel, B.EVENTS)) == []
    rows = with_utility(B.scored(spark, TESTDATA), B.ENTITY)
    assert broadcast_generators(rows.groupBy("site").sum("u_best")) == []
    assert broadcast_generators(onsets(panel, B.ENTITY)) == []


@pytest.mark.parametrize(
    "query",
    ["b2_inclusion", "b3_inclusion_report", "d1_cohort_counts", "d3_length_of_stay", "f3_accuracy_f_measure", "f4_prevalence_counts",
     "f5_brier", "f6_reliability", "f7_alert_rate", "f11_best_threshold", "f12_alert_burden"],
)
def test_queries_on_the_panel_broadcast_no_hours(spark, query):
    """What goes to the driver is made of entities, groups or thresholds."""
    from stayline.plans.queries import QUERIES

    assert broadcast_generators(QUERIES[query](spark, TESTDATA)) == []


def test_hours_are_made_in_as_many_tasks_as_asked_for(spark):
    """However few bytes the readings take, Spark does not merge the tasks that make the hours."""
    span = spark.createDataFrame([("a", 0, 1.0), ("a", 99_999, 2.0), ("b", 7, 3.0)], "e string, t long, x double")
    parts = dense_grid(span, ["e"], "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in parts) == 100_001


def test_blocks_with_halo_hold_every_hour(spark):
    """Hours before 1970, gaps over whole blocks, readings on block borders."""
    from stayline.operators.grid import fill_blocks, reading_blocks

    read = {("a", t): float(t) for t in (-600, -1, 0, 440, 511, 512, 2100)} | {("b", 511): 1.0, ("c", 505): 2.0, ("c", 520): 3.0}
    rows = spark.createDataFrame([(e, t, x) for (e, t), x in read.items()], "e string, t long, x double")
    first = {"a": -600, "b": 511, "c": 505}
    last = {"a": 2100, "b": 511, "c": 520}
    want = set()
    for e in first:
        for t in range(first[e], last[e] + 1):
            for b in {t // 512, (t + 72) // 512}:
                if b <= last[e] // 512:
                    want.add((e, b, t, t - first[e], b != t // 512, read.get((e, t))))
    got = [
        (r["e"], r["_block"], r["t"], r["hour"], r["_halo"], r["x"])
        for r in fill_blocks(reading_blocks(rows, ["e"], "t", 72), ["e"], "t", 72).collect()
    ]
    assert len(got) == len(want) and set(got) == want


def test_features_keep_the_number_of_tasks(spark):
    """Rows by block are not merged into a few tasks by their bytes in the shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = PanelSpec(entity="e", clock="clock", label="label", variables=("HR",), static=(), model_static=())
    rows = spark.range(20_000).selectExpr(
        "if(id < 0, 'B', 'A') AS site", "if(id < 0, 'b', 'a') AS e", "cast(id AS int) AS hour", "cast(id AS int) AS clock", "0 AS label", "if(id % 50 = 0, 1.0D, null) AS HR"
    )
    for made in (FT.recency(rows, spec), FT.window_features(rows, spec)):
        parts = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == n and sum(r["count"] for r in parts) == 20_000


def shuffled(df):
    """What each shuffle of the finished plan carries, one list of columns a shuffle."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line]


def test_features_of_a_panel_in_blocks_shuffle_no_hours(spark):
    """Readings and summaries are shuffled once; hours, their features and their split stay where they are made."""
    from stayline.operators.cohort import split_sites, with_split
    from stayline.plans import bindings as B

    plain = B.cohort(spark, TESTDATA)
    panel = B.cohort_blocks(spark, TESTDATA, 23, split=True)
    n_hours = plain.count()
    pairs = [
        (FT.window_features(panel, B.EVENTS), FT.window_features(plain, B.EVENTS)),
        (FT.minimal_features(panel, B.EVENTS, ["split"]),
         with_split(FT.minimal_features(plain, B.EVENTS), split_sites(B.events(spark, TESTDATA), B.EVENTS), B.EVENTS)),
    ]
    for stays, dealt in pairs:
        stays, dealt = (d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes]) for d in (stays, dealt))
        assert sorted(stays.columns) == sorted(dealt.columns)
        assert {tuple(r) for r in stays.collect()} == {tuple(r) for r in dealt.select(*stays.columns).collect()}
        # The hours of a panel dealt out again go through one exchange more, and another for the split.
        assert len(shuffled(stays)) < len(shuffled(dealt))
        assert stays.count() == n_hours


def test_trailing_statistics_of_one_list(spark):
    """Equal values, values far from zero, one and two readings, none at all, infinite ones."""
    xs = [None, 1e9, 1e9 + 1, None, None, None, None, 3.0, 3.0, 3.0, None, float("inf"), None]
    got = {r["hour"]: r for r in FT.window_features_long(panel(spark, xs), ONE, (3, 6)).collect()}
    assert [got[0][f"{s}_3"] for s in STATISTICS] == [None] * 5
    assert got[1]["slope_3"] is None and got[1]["mean_3"] == 1e9
    assert got[2]["slope_3"] == 1.0 and got[2]["last_6"] == 1e9 + 1
    assert got[5]["slope_3"] is None and got[5]["slope_6"] == 1.0
    assert got[9]["slope_3"] == 0.0 and got[9]["min_6"] == 3.0
    assert got[12]["max_3"] == float("inf") and got[12]["last_3"] == float("inf")
