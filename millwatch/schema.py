"""The one place for names, domains and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, orders, domains and limits that results depend on.
# ---------------------------------------------------------------------------

CLASSES = ("no_failure", "TWF", "HDF", "PWF", "OSF")
NO_FAILURE = "no_failure"
TIERS = ("low", "elevated", "high")
GRADES = ("L", "M", "H")

# CSV header -> column
CSV_COLUMNS = {
    "UDI": "udi",
    "Product ID": "product_id",
    "Type": "type",
    "Air temperature [K]": "air_temp_k",
    "Process temperature [K]": "process_temp_k",
    "Rotational speed [rpm]": "rotational_speed_rpm",
    "Torque [Nm]": "torque_nm",
    "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}

MODE_FLAGS = ("twf", "hdf", "pwf", "osf", "rnf")
FLAGS = ("machine_failure", *MODE_FLAGS)
# A row with several mode flags takes the first of these as its label.
LABEL_PRIORITY = ("TWF", "PWF", "OSF", "HDF")

RAW_INPUTS = (
    "type",
    "air_temp_k",
    "process_temp_k",
    "rotational_speed_rpm",
    "torque_nm",
    "tool_wear_min",
)
PHYSICS = ("power_w", "temp_diff_k", "strain_min_nm")
FEATURES = (*RAW_INPUTS, *PHYSICS)
NUMERIC_FEATURES = tuple(c for c in FEATURES if c != "type")
CATEGORICAL_FEATURES = ("type",)

# Physics limits behind the heat, power and overstrain modes
HEAT_DIFF_LIMIT_K = 8.6
HEAT_RPM_LIMIT = 1380
POWER_LOW_W = 3500
POWER_HIGH_W = 9000
STRAIN_LIMITS = {"L": 11000, "M": 12000, "H": 13000}
WEAR_WINDOW = (200, 240)

# Review budget, drift and workload rules
BUDGET_FRACTION = 0.02
DRIFT_THRESHOLD = 0.1
MIN_WINDOW_ROWS = 1000
EXPECTED_FLAGGED_SHARE = 391 / 7992
WASSERSTEIN = "Wasserstein distance (normed)"
JENSEN_SHANNON = "Jensen-Shannon distance"
INSUFFICIENT_DATA = "insufficient_data"

TEST_FRACTION = 0.2
CV_FOLDS = 5
SEED = 42

PROBA_COLUMNS = ("p_no_failure", "p_twf", "p_hdf", "p_pwf", "p_osf")
LOG_TABLE = "predictions_log"
LOG_COLUMNS = (
    "model_name",
    "model_version",
    *FEATURES,
    *PROBA_COLUMNS,
    "predicted_mode",
    "runner_up_mode",
    "confidence_score",
    "elevated_threshold",
    "risk_tier",
)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------


def _struct(fields: list[tuple[str, T.DataType]], nullable: bool = False) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype in fields])


_INPUT_TYPES: list[tuple[str, T.DataType]] = [
    ("type", T.StringType()),
    ("air_temp_k", T.DoubleType()),
    ("process_temp_k", T.DoubleType()),
    ("rotational_speed_rpm", T.IntegerType()),
    ("torque_nm", T.DoubleType()),
    ("tool_wear_min", T.IntegerType()),
]

READINGS_SCHEMA = _struct(
    [
        ("udi", T.LongType()),
        ("product_id", T.StringType()),
        *_INPUT_TYPES,
        *[(flag, T.BooleanType()) for flag in FLAGS],
    ]
)

REQUEST_SCHEMA = _struct(_INPUT_TYPES, nullable=True)

LOG_SCHEMA = _struct(
    [
        ("request_id", T.StringType()),
        ("created_at", T.TimestampType()),
        ("model_name", T.StringType()),
        ("model_version", T.IntegerType()),
        *_INPUT_TYPES,
        *[(name, T.DoubleType()) for name in (*PHYSICS, *PROBA_COLUMNS)],
        ("predicted_mode", T.StringType()),
        ("runner_up_mode", T.StringType()),
        ("confidence_score", T.DoubleType()),
        ("elevated_threshold", T.DoubleType()),
        ("risk_tier", T.StringType()),
    ]
)
