"""Small tables whose results are worked out by hand."""

from __future__ import annotations

from millwatch import schema as S

SCORED = "udi long, y int, proba array<double>"

# Twelve rows, true and predicted codes: one healthy row taken for HDF, one TWF for PWF, one OSF missed
METRICS_Y = [0, 0, 0, 0, 0, 1, 1, 2, 2, 3, 4, 4]
METRICS_PRED = [0, 0, 0, 0, 2, 1, 3, 2, 2, 3, 4, 0]

# Seven rows: 0-4 are healthy, of which 4 is predicted TWF; 5 is HDF but predicted healthy, 6 is PWF
RISK_PROBA = [
    [0.92, 0.02, 0.02, 0.02, 0.02],
    [0.85, 0.15, 0.00, 0.00, 0.00],
    [0.75, 0.00, 0.25, 0.00, 0.00],
    [0.65, 0.00, 0.00, 0.35, 0.00],
    [0.30, 0.70, 0.00, 0.00, 0.00],
    [0.45, 0.05, 0.40, 0.05, 0.05],
    [0.20, 0.00, 0.00, 0.80, 0.00],
]
RISK_Y = [0, 0, 0, 0, 0, 2, 3]


def one_hot(code: int) -> list[float]:
    return [1.0 if k == code else 0.0 for k in range(len(S.CLASSES))]


def scored(spark, y, proba):
    return spark.createDataFrame(list(zip(range(101, 101 + len(y)), y, proba)), SCORED)


READING = {
    "type": "L",
    "air_temp_k": 299.4,
    "process_temp_k": 309.8,
    "rotational_speed_rpm": 1480,
    "torque_nm": 47.5,
    "tool_wear_min": 36,
}

# Power is 47.5 Nm at 1480 rpm, strain 36 min x 47.5 Nm
LOG_ROW = {
    "model_name": "press-line",
    "model_version": 3,
    **READING,
    "power_w": 7361.8,
    "temp_diff_k": 10.4,
    "strain_min_nm": 1710.0,
    "p_no_failure": 0.5,
    "p_twf": 0.0625,
    "p_hdf": 0.25,
    "p_pwf": 0.125,
    "p_osf": 0.0625,
    "predicted_mode": "no_failure",
    "runner_up_mode": "HDF",
    "confidence_score": 0.5,
    "elevated_threshold": 0.75,
    "risk_tier": "low",
}


def log_frame(spark, *changes):
    from pyspark.sql import types as T

    fields = [f for f in S.LOG_SCHEMA.fields if f.name in S.LOG_COLUMNS]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    rows = [{**LOG_ROW, **change} for change in changes]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], schema)


def readings_frame(spark, rows):
    """Readings from (udi, changes) pairs."""
    base = {"product_id": "M00001", **READING, **{f: False for f in S.FLAGS}}
    full = [{**base, **changes, "udi": udi} for udi, changes in rows]
    return spark.createDataFrame(
        [tuple(r[n] for n in S.READINGS_SCHEMA.names) for r in full], S.READINGS_SCHEMA
    )
