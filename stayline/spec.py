"""Names and settings: which column plays which role in a panel."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The 41 columns of a raw per-stay file, in file order.
VITALS = ("HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp", "EtCO2")
LABS = (
    "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2", "SaO2", "AST", "BUN", "Alkalinephos",
    "Calcium", "Chloride", "Creatinine", "Bilirubin_direct", "Glucose", "Lactate",
    "Magnesium", "Phosphate", "Potassium", "Bilirubin_total", "TroponinI", "Hct", "Hgb",
    "PTT", "WBC", "Fibrinogen", "Platelets",
)
DEMOGRAPHICS = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime", "ICULOS")
LABEL = "SepsisLabel"
CLINICAL = VITALS + LABS
RAW_COLUMNS = CLINICAL + DEMOGRAPHICS + (LABEL,)

# Plausible bounds per variable (used to count, never to clip).
PLAUSIBLE_RANGE = {
    "HR": (10.0, 250.0),
    "O2Sat": (10.0, 100.0),
    "Temp": (20.0, 45.0),
    "SBP": (20.0, 300.0),
    "MAP": (10.0, 250.0),
    "DBP": (5.0, 200.0),
    "Resp": (0.0, 80.0),
    "EtCO2": (0.0, 100.0),
    "BaseExcess": (-40.0, 40.0),
    "HCO3": (1.0, 60.0),
    "FiO2": (0.2, 1.0),
    "pH": (6.5, 8.0),
    "PaCO2": (5.0, 150.0),
    "SaO2": (10.0, 100.0),
    "AST": (0.0, 20000.0),
    "BUN": (0.0, 300.0),
    "Alkalinephos": (0.0, 3000.0),
    "Calcium": (2.0, 20.0),
    "Chloride": (50.0, 160.0),
    "Creatinine": (0.0, 30.0),
    "Bilirubin_direct": (0.0, 50.0),
    "Glucose": (5.0, 1500.0),
    "Lactate": (0.0, 40.0),
    "Magnesium": (0.2, 10.0),
    "Phosphate": (0.2, 25.0),
    "Potassium": (1.0, 12.0),
    "Bilirubin_total": (0.0, 60.0),
    "TroponinI": (0.0, 500.0),
    "Hct": (5.0, 75.0),
    "Hgb": (2.0, 25.0),
    "PTT": (5.0, 300.0),
    "WBC": (0.0, 300.0),
    "Fibrinogen": (10.0, 1500.0),
    "Platelets": (1.0, 2000.0),
}

# Trailing windows in hours, statistics per window, in feature order.
WINDOWS = (6, 12, 24)
STATISTICS = ("min", "max", "mean", "last", "slope")

# Age bands of the subgroup report (label, from, below).
AGE_BANDS = (("<40", 0, 40), ("40-65", 40, 65), ("65-80", 65, 80), ("80+", 80, None))
MIN_POSITIVES = 50


@dataclass(frozen=True)
class PanelSpec:
    """Role of each column. Every operator takes one, so any table can be bound."""

    entity: str = "patient_id"
    site: str = "site"
    hour: str = "hour"
    clock: str = "ICULOS"
    label: str = LABEL
    variables: tuple[str, ...] = CLINICAL
    static: tuple[str, ...] = DEMOGRAPHICS
    #: Statics that enter a model. Unit flags name the place, so they stay out.
    model_static: tuple[str, ...] = ("Age", "Gender", "HospAdmTime", "ICULOS")
    age: str = "Age"
    gender: str = "Gender"
    units: tuple[str, str] = ("Unit1", "Unit2")

    @property
    def key(self) -> list[str]:
        """Entities are told apart by site and id together."""
        return [self.site, self.entity]

    @property
    def side(self) -> list[str]:
        """Columns carried next to features and never used as model inputs."""
        return [self.entity, self.site, self.hour, self.label]

    def minimal_feature_columns(self) -> list[str]:
        """Order of the baseline set: missing flags, carried values, statics."""
        return (
            [f"{v}_missing" for v in self.variables]
            + [f"{v}_last" for v in self.variables]
            + list(self.model_static)
        )

    def window_feature_columns(self, windows: tuple[int, ...] = WINDOWS) -> list[str]:
        """Frozen names and order of the full set; a saved model relies on it."""
        recency = [f"{v}_{s}" for v in self.variables for s in ("missing", "hours_since_measured")]
        stats = [f"{v}_{s}_{w}" for w in windows for v in self.variables for s in STATISTICS]
        return recency + stats + list(self.model_static)

    def with_(self, **changes) -> "PanelSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class StudyConfig:
    """One place for every setting that changes a reported number."""

    # The published study settings.
    seed: int = 20190801
    sites: tuple[tuple[str, str], ...] = (("A", "training_setA"), ("B", "training_setB"))
    min_hours: int = 8
    train_fraction: float = 0.8
    held_out_train_fraction: float = 0.8
    windows: tuple[int, ...] = WINDOWS
    boosting_rounds: int = 600
    learning_rates: tuple[float, ...] = (0.02, 0.05, 0.1)
    leaves: tuple[int, ...] = (15, 31, 63)
    min_leaf_rows: tuple[int, ...] = (20, 100)
    sweep_steps: int = 100
    transfer_n: tuple[int, ...] = (0, 50, 100, 250, 500, 1000, 2000)
    transfer_draws: int = 5
    fine_tune_rounds: int = 200


CONFIG = StudyConfig()
