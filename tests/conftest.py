import math
import random
import tempfile

import pytest

from stayline.session import local_session
from stayline.spec import CLINICAL, RAW_COLUMNS

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4)
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()


# id, site, hours, onset, first clock, extras
STAYS = [
    ("p000001", "A", 48, None, 1, {}),
    ("p000002", "A", 36, 20, 1, {}),
    ("p000003", "A", 8, None, 1, {}),
    ("p000004", "A", 7, None, 1, {}),
    ("p000005", "A", 1, None, 1, {}),
    ("p000006", "A", 24, 0, 1, {}),
    ("p000007", "A", 30, None, 1, {"never": ("Lactate", "Fibrinogen", "TroponinI")}),
    ("p000008", "A", 30, None, 1, {"only_last": "Bilirubin_total"}),
    ("p000010", "A", 18, None, 1, {"reverse": True}),
    ("p000012", "A", 28, None, 1, {"set": {("HR", 5): 300, ("Temp", 9): 0, ("SBP", 12): -5}}),
    ("p000013", "A", 72, 60, 5, {}),
    ("p100001", "B", 40, None, 1, {}),
    ("p100002", "B", 34, 18, 1, {}),
    ("p100004", "B", 6, None, 1, {}),
]


def stay_lines(pid, hours, onset, clock, extra):
    rng = random.Random(pid)
    lines = []
    for h in range(hours):
        row = {}
        for v in CLINICAL:
            seen = rng.random() < 0.4
            row[v] = f"{20 + 60 * rng.random():.2f}" if seen else "NaN"
            if v in extra.get("never", ()):
                row[v] = "NaN"
            if v == extra.get("only_last"):
                row[v] = "1.25" if h == hours - 1 else "NaN"
            if (v, h) in extra.get("set", {}):
                row[v] = str(extra["set"][(v, h)])
        row |= {"Age": "64", "Gender": "1", "Unit1": "NaN", "Unit2": "NaN", "HospAdmTime": "-3.5"}
        row["ICULOS"] = str(clock + h)
        row["SepsisLabel"] = str(int(onset is not None and h >= onset))
        lines.append("|".join(row[c] for c in RAW_COLUMNS))
    return lines[::-1] if extra.get("reverse") else lines


def write_stays(root, stays=STAYS):
    for pid, site, hours, onset, clock, extra in stays:
        folder = root / f"training_set{site}"
        folder.mkdir(parents=True, exist_ok=True)
        lines = ["|".join(RAW_COLUMNS), *stay_lines(pid, hours, onset, clock, extra)]
        (folder / f"{pid}.psv").write_text("\n".join(lines) + "\n")
    return str(root)


@pytest.fixture(scope="session")
def raw_root(tmp_path_factory):
    return write_stays(tmp_path_factory.mktemp("raw"))


@pytest.fixture(scope="session")
def cohort(spark, raw_root):
    from stayline.sources.psv import load_cohort

    return load_cohort(spark, raw_root).cache()


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
