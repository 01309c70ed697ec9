import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stayline.operators.features import observable_columns, window_features
from stayline.sources import ledger, manifest, provenance, psv, sink, stages, store
from stayline.spec import RAW_COLUMNS, PanelSpec
from tests import synth
from tests.conftest import STAYS, stay_lines, write_stays

SPEC = PanelSpec()
HEADER = "|".join(RAW_COLUMNS)


def add(root, name, text, site="A"):
    folder = root / f"training_set{site}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def good(pid="p000050", n=9):
    return HEADER + "\n" + "\n".join(stay_lines(pid, n, None, 1, {})) + "\n"


def test_cohort_shape(cohort):
    n = {r["patient_id"]: (r["site"], r["count"]) for r in cohort.groupBy("patient_id", "site").count().collect()}
    assert n == {pid: (site, hours) for pid, site, hours, *_ in STAYS}
    late = cohort.filter("patient_id = 'p000013'").agg(F.min("ICULOS"), F.min("hour"), F.max("hour")).first()
    assert tuple(late) == (5.0, 0, 71)
    turned = cohort.filter("patient_id = 'p000010'").orderBy("hour").select("ICULOS").collect()
    assert [r[0] for r in turned] == [float(i) for i in range(1, 19)]


def test_nulls_are_null_and_impossible_values_stay(cohort):
    assert cohort.filter("patient_id = 'p000007' AND Lactate IS NOT NULL").count() == 0
    assert cohort.filter(F.isnan("Lactate")).count() == 0
    assert cohort.filter("patient_id = 'p000012' AND hour = 5").first()["HR"] == 300.0


def test_bad_header_name_label_and_cells_fail(spark, tmp_path):
    wrong = good().replace("HR|O2Sat", "O2Sat|HR", 1)
    cases = {
        "header": ("p000001.psv", wrong),
        "name": ("pX1.psv", good()),
        "label": ("p000002.psv", HEADER + "\n" + "|".join(["1"] * 40 + ["2"]) + "\n"),
        "cell": ("p000003.psv", HEADER + "\n" + "|".join(["abc"] + ["1"] * 39 + ["0"]) + "\n"),
        "empty": ("p000004.psv", HEADER + "\n"),
        "clock": ("p000005.psv", HEADER + "\n" + ("|".join(["1"] * 40 + ["0"]) + "\n") * 2),
    }
    for kind, (name, text) in cases.items():
        root = tmp_path / kind
        add(root, name, text)
        add(root, "p000050.psv", good())
        add(root, "p100050.psv", good(), "B")
        with pytest.raises((ValueError, PySparkException, Py4JJavaError)):
            psv.load_cohort(spark, str(root)).collect()


def test_quarantine(spark, tmp_path):
    add(tmp_path, "p000001.psv", good())
    add(tmp_path, "p000002.psv", good()[:-5].rsplit("|", 3)[0] + "\n")
    add(tmp_path, "p000003.psv", HEADER + "\n")
    add(tmp_path, "p000004.psv", good().split("\n", 1)[1])
    add(tmp_path, "p000005.psv", "")
    add(tmp_path, "p100001.psv", good(), "B")
    got = {r["path"].rsplit("/", 1)[1]: (r["wrong_header"], r["wrong_field_count"], r["no_rows"]) for r in psv.quarantine(spark, str(tmp_path)).collect()}
    assert got == {"p000002.psv": (0, 1, 0), "p000003.psv": (0, 0, 1), "p000004.psv": (1, 0, 0), "p000005.psv": (1, 0, 1)}


def test_files_of_zero_bytes_are_found(spark, tmp_path):
    add(tmp_path, "p000001.psv", good())
    add(tmp_path, "p000002.psv", "")
    add(tmp_path, "p100001.psv", good(), "B")
    listed = {r["name"]: (r["site"], r["length"] > 0) for r in psv.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"p000001.psv": ("A", True), "p000002.psv": ("A", False), "p100001.psv": ("B", True)}
    with pytest.raises(ValueError, match="p000002"):
        psv.load_cohort(spark, str(tmp_path))
    assert psv.load_cohort(spark, str(tmp_path), strict=False).select("patient_id").distinct().count() == 2


def test_manifest(spark, tmp_path):
    write_stays(tmp_path)
    first = manifest.site_manifest(manifest.file_hashes(spark, str(tmp_path)))
    stored = first.collect()
    assert {r["site"]: r["n"] for r in stored} == {"A": 11, "B": 3}
    recorded = spark.createDataFrame([*map(tuple, stored), ("C", 1, "x")], first.schema)
    (tmp_path / "training_setB" / "p100001.psv").write_text(good())
    now = manifest.site_manifest(manifest.file_hashes(spark, str(tmp_path)))
    status = {r["site"]: r["status"] for r in manifest.verify(recorded, now).collect()}
    assert status == {"A": "OK", "B": "FAIL", "C": "SKIP"}
    with pytest.raises(ValueError, match="mismatch"):
        manifest.require_verified(recorded, now)


def test_row_digest_ignores_order_not_content(spark):
    df = spark.createDataFrame([("g", i, None if i % 3 else "x") for i in range(50)], "g string, i int, s string")
    digest = lambda d: manifest.row_digest(d, ["g"], [F.col("i"), F.col("s")]).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.desc("i")).repartition(7))
    assert digest(df) != digest(df.withColumn("i", F.col("i") + 1)) and digest(df) != digest(df.union(df.limit(1)))


def test_cohort_store(spark, cohort, tmp_path):
    with pytest.raises(FileNotFoundError, match="build it first"):
        store.read_cohort(spark, str(tmp_path / "none"))
    store.write_cohort(cohort, str(tmp_path / "c"))
    back = store.read_cohort(spark, str(tmp_path / "c"))
    assert back.select(cohort.columns).exceptAll(cohort).count() == 0 and back.count() == cohort.count()
    assert "PartitionFilters: [isnotnull(site" in back.filter("site = 'A'")._jdf.queryExecution().toString()


def test_flat_round_trip(spark, cohort, tmp_path):
    flat = store.flat_export(cohort, SPEC, site="A", limit=3)
    assert len(flat.columns) == len(set(flat.columns))
    assert sorted({r[0] for r in flat.select("patient_id").collect()}) == ["p000001", "p000002", "p000003"]
    store.write_flat(flat, str(tmp_path / "f"))
    back = store.read_flat(spark, str(tmp_path / "f"))
    assert back.count() == 48 + 36 + 8
    assert back.select(flat.columns).exceptAll(flat).count() == 0
    spark.read.option("header", True).csv(str(tmp_path / "f")).drop("HR").write.option("header", True).csv(str(tmp_path / "g"))
    with pytest.raises(ValueError, match="HR"):
        store.read_flat(spark, str(tmp_path / "g"))


def test_design_cache(spark, cohort, tmp_path):
    path, columns = str(tmp_path / "d"), SPEC.window_feature_columns((6,))
    assert not store.design_is_current(spark, path, columns, "x")
    one = window_features(cohort.filter("patient_id = 'p000003'"), SPEC, (6,))
    store.write_design(one, path, columns, (6,), "x")
    assert store.design_is_current(spark, path, columns, "x")
    assert not store.design_is_current(spark, path, columns[::-1], "x")
    assert not store.design_is_current(spark, path, columns, "y")
    rows, meta = store.read_design(spark, path)
    assert meta["n_rows"] == 8
    assert store.concatenate_designs([rows, rows]).count() == 16
    with pytest.raises(ValueError, match="same order"):
        store.concatenate_designs([rows, rows.select(rows.columns[::-1])])
    with pytest.raises(ValueError, match="no rows"):
        store.write_design(one.limit(0), path, columns, (6,), "x")


def test_results_merge_by_key(spark, tmp_path):
    path = str(tmp_path / "r")
    ledger.merge_result(spark, path, "baseline", {"auroc": 0.7})
    ledger.merge_result(spark, path, "window", {"auroc": 0.8})
    ledger.merge_result(spark, path, "baseline", {"auroc": 0.75})
    assert ledger.read_result(spark, path, "baseline") == {"auroc": 0.75}
    assert ledger.read_result(spark, path, "window") == {"auroc": 0.8}
    assert ledger.read_results(spark, path).count() == 2


def test_held_out_site_is_scored_once(spark, tmp_path):
    path, calls = str(tmp_path / "r"), []
    score = lambda: calls.append(1) or {"auroc": 0.7}
    now = ledger.fingerprint({"model": [1, 2], "threshold": 0.5})
    assert not ledger.score_once(spark, path, "cells", now, score)["rescored"]
    assert ledger.score_once(spark, path, "cells", now, score)["results"] == {"auroc": 0.7}
    assert len(calls) == 1
    changed = ledger.fingerprint({"model": [1, 3], "threshold": 0.5})
    with pytest.raises(RuntimeError, match="model changed"):
        ledger.score_once(spark, path, "cells", changed, score)
    assert ledger.score_once(spark, path, "cells", changed, score, force=True)["rescored"]
    assert len(calls) == 2


def test_one_of_two_drivers_scores(spark, tmp_path):
    """Both look before either has claimed: the file system lets one claim succeed, the other does not score."""
    path, calls = str(tmp_path / "r"), []
    now = ledger.fingerprint({"model": 1})

    def slow():
        calls.append("first")
        with pytest.raises(RuntimeError, match="another driver"):  # a second driver comes while the first scores
            ledger.score_once(spark, path, "cells", now, lambda: calls.append("second") or {})
        return {"auroc": 0.7}

    assert ledger.score_once(spark, path, "cells", now, slow)["results"] == {"auroc": 0.7} and calls == ["first"]
    assert ledger.claim(spark, path, "race", 0) and not ledger.claim(spark, path, "race", 0)
    with pytest.raises(ZeroDivisionError):  # a failed scoring gives its claim back
        ledger.score_once(spark, path, "failing", now, lambda: 1 / 0)
    assert ledger.score_once(spark, path, "failing", now, lambda: {"x": 1})["results"] == {"x": 1}
    with pytest.raises(RuntimeError, match="being scored"):  # claimed by a driver that died
        ledger.score_once(spark, path, "race", now, lambda: {})
    assert ledger.score_once(spark, path, "race", now, lambda: {"y": 2}, force=True)["results"] == {"y": 2}


def test_fingerprint_of_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", None, None), ("b", None, None)], "k string, n int, x double")
    same = ledger.data_fingerprint(df.repartition(3), ["k", "n", "x"])
    assert same == ledger.data_fingerprint(df, ["k", "n", "x"]) != ledger.data_fingerprint(df.distinct(), ["k", "n", "x"])
    assert ledger.data_fingerprint(df.limit(0), ["k"]) == "0:"


def test_origin_is_the_same_for_repeated_runs(spark):
    inputs = spark.createDataFrame([("A", "abc"), ("B", "def")], "site string, digest string")
    key = lambda d, seed=1: provenance.origin_key(provenance.origin(spark, d, seed)).first()["origin"]
    assert key(inputs) == key(inputs.repartition(3))
    assert key(inputs) != key(inputs, seed=2)
    assert key(inputs) != key(inputs.where("site = 'A'"))
    facts = {(r["kind"], r["name"]): r["value"] for r in provenance.origin(spark, inputs).collect()}
    assert facts["input", "B"] == "def" and facts["session", "spark"] == spark.version
    assert provenance.with_origin(spark.range(2), "k").where("origin = 'k'").count() == 2
    assert provenance.tree_facts("/") == []


def test_synthetic_cohort(spark):
    a = synth.synthetic_cohort(spark, 40, 30, fault_rate=0.01, variables=("HR", "Lactate"))
    b = synth.synthetic_cohort(spark, 40, 30, fault_rate=0.01, variables=("HR", "Lactate")).repartition(3)
    assert a.exceptAll(b).count() == 0
    seen = a.agg(F.count("HR").alias("hr"), F.count("Lactate").alias("lac"), F.count("*").alias("n")).first()
    assert seen["lac"] < seen["hr"] / 3 and a.filter("HR = -999").count() > 0
    assert a.select("site", "patient_id").distinct().count() == 40


def test_a_second_load_writes_nothing(spark, tmp_path):
    """Every key once; only buckets with a key whose cell is taken are read, only new rows are written."""
    path, at = str(tmp_path / "sink"), lambda n: sink.stored(spark, path, "key string, n bigint").count() == n
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k|"), "id").alias("key"), F.col("id").alias("n"))
    assert at(0)
    new, counts = sink.load(rows(0, 500), path, buckets=8, pages=2)
    assert new.count() == 500 and counts["checked"] == counts["read_files"] == 0 and at(500)
    again, counts = sink.load(rows(0, 500), path)
    assert again.count() == 0 and counts["written_files"] == 0 and counts["checked"] == 8 and at(500)
    one, counts = sink.load(rows(7, 8), path)
    assert one.count() == 0 and counts["checked"] == 1 and 1 <= counts["read_files"] <= 2
    new, counts = sink.load(rows(0, 600), path)
    assert {r["n"] for r in new.collect()} == set(range(500, 600)) and at(600)
    far, counts = sink.load(rows(10**6, 10**6 + 3), path)  # their cells are empty: nothing is read
    assert far.count() == 3 and counts["read_files"] <= 2 and at(603)
    assert sink.load(rows(0, 0), path)[1]["written_files"] == 0
    twice = rows(900, 910).unionByName(rows(900, 910).withColumn("n", F.col("n") + 1000))
    assert sorted(r["n"] for r in sink.load(twice, path)[0].collect()) == list(range(900, 910)) and at(613)
    with pytest.raises((PySparkException, Py4JJavaError), match="without a key"):
        sink.load(spark.sql("SELECT CAST(NULL AS STRING) AS key, CAST(1 AS BIGINT) AS n"), path)


def test_of_two_loads_one_commits_first(spark, tmp_path, monkeypatch):
    """Another driver commits while this one works: it looks again, and each key is stored once."""
    path = str(tmp_path / "sink")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("key"))
    sink.load(rows(0, 10), path, buckets=2, pages=1)
    inner, once = sink._unseen, []

    def slow(*args):
        found = inner(*args)
        if not once:
            once.append(1)
            assert sink.load(rows(5, 15), path)[0].count() == 5
        return found

    monkeypatch.setattr(sink, "_unseen", slow)
    new, _ = sink.load(rows(12, 20), path)
    assert sorted(int(r["key"]) for r in new.collect()) == [15, 16, 17, 18, 19]
    assert sink.stored(spark, path, "key string").count() == 20


def test_stages_are_built_once_for_the_same_input(spark, tmp_path):
    root, built = str(tmp_path / "stages"), []
    rows = spark.createDataFrame([("A", i, None if i % 3 else i / 7) for i in range(40)], "site string, i int, x double")

    def get(source=rows, columns=("site", "y"), settings=None):
        def build():
            built.append(1)
            return source.groupBy("site").agg(F.sum("x").alias("y"))

        return stages.stage(spark, root, "sums", {"rows": source}, columns, build, settings)

    first = get().collect()
    assert get(rows.repartition(5)).collect() == first and len(built) == 1  # order and partitioning do not matter
    get(rows.filter("i > 3"))
    get(settings={"window": 6})
    assert len(built) == 3
    with pytest.raises(ValueError, match="columns"):
        get(columns=("y", "site"))
    names = [n for n in stages.files.names(spark, root) if stages.read_stage(spark, root, n) is not None]
    assert len(names) == 3
    facts = {(r["kind"], r["name"]): r["value"] for r in stages.read_origin(spark, root, names[0]).collect()}
    assert facts["stage", "code"] == stages.code_revision() and ("input", "rows") in facts
    # a driver that was lost before the end: its folders are not read, the stage is built again
    stages.files.remove(spark, f"{root}/{names[0]}/{stages.DONE}")
    assert stages.read_stage(spark, root, names[0]) is None
    assert stages.release(spark, root, 1) == [] and set(stages.release(spark, root, 0, keep=names[1:])) >= {names[0]}
    assert set(names[1:]) == set(stages.files.names(spark, root))


def test_records_that_are_alike_are_stored_side_by_side(spark, tmp_path):
    """Pages chosen by columns that follow from the key: loads stay the same, and rows are dealt out once, by page."""
    path = str(tmp_path / "near")
    rows = lambda lo, hi: spark.range(lo, hi).select(F.format_string("k%d", "id").alias("key"), F.floor(F.col("id") / 10).alias("n"))
    near = [F.col("n")]
    placed = sink._placed(rows(0, 300), "key", 8, 2, near)
    assert placed.groupBy("n").agg(F.countDistinct("_page").alias("p")).agg(F.max("p")).first()[0] == 1
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(_page" in plan
    load = lambda lo, hi: sink.load(rows(lo, hi), path, buckets=8, pages=2, near=near)[0].count()
    assert (load(0, 200), load(100, 300), load(0, 300)) == (200, 100, 0)
    assert sorted(r["key"] for r in sink.stored(spark, path, "key string, n bigint").collect()) == sorted(f"k{i}" for i in range(300))
