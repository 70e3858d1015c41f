"""SQL oracles in DuckDB's dialect, written apart from the Spark operators.

Each oracle derives the sensor tables from `events` on its own and states the
result in plain SQL; where the operator narrows, buckets or deals, the oracle
ranks, sorts or repeats.
"""

from __future__ import annotations

SEED = "42"
LOG_THRESHOLD = "0.15e0"
CUTOFF = "TIMESTAMP '2024-01-20 00:00:00'"
BUDGET = "0.10e0"
MIN_ROWS = 1000
EXPECTED_FLAGGED = "(391e0/7992e0)"
SIZES = (100, 200, 300, 500, 750, 1000)
WINDOWS = 200

MODES = ("no_failure", "TWF", "HDF", "PWF", "OSF")
P_COLUMNS = ("p_no_failure", "p_twf", "p_hdf", "p_pwf", "p_osf")
FLAGS = ("machine_failure", "twf", "hdf", "pwf", "osf", "rnf")
RAW = ("type", "air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min")
PHYSICS = ("power_w", "temp_diff_k", "strain_min_nm")
FEATURES = (*RAW, *PHYSICS)
NUMERIC = FEATURES[1:]
READING_COLUMNS = ("udi", "product_id", *RAW, *FLAGS)
LOG_COLUMNS = (
    "model_name", "model_version", *FEATURES, *P_COLUMNS, "predicted_mode", "runner_up_mode",
    "confidence_score", "elevated_threshold", "risk_tier",
)


def cols(*names: str, of: str = "") -> str:
    prefix = f"{of}." if of else ""
    return ", ".join(f"{prefix}{n}" for n in names)


def u(salt: str, key: str = "udi") -> str:
    text = f"substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8)"
    return f"(CAST('0x' || {text} AS BIGINT) / 4294967296e0)"


def centred(salt: str) -> str:
    return f"({u(salt + '1')} + {u(salt + '2')} + {u(salt + '3')} - 1.5e0)"


def physics(power: str = "") -> str:
    power = power or "torque_nm * ((rotational_speed_rpm * 2 * pi()) / 60)"
    return (
        f"{power} AS power_w, process_temp_k - air_temp_k AS temp_diff_k, "
        "tool_wear_min * torque_nm AS strain_min_nm"
    )


LIMIT = "CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 WHEN 'H' THEN 13000 END"
HDF = "(temp_diff_k < 8.6e0 AND rotational_speed_rpm < 1380)"
PWF = "(power_w < 3500 OR power_w > 9000)"
OSF = f"(strain_min_nm > {LIMIT})"
WEAR = "(tool_wear_min BETWEEN 200 AND 240)"
N_MODES = "(twf::INT + hdf::INT + pwf::INT + osf::INT + rnf::INT)"
LABEL = (
    "CASE WHEN NOT machine_failure THEN 'no_failure' WHEN twf THEN 'TWF' WHEN pwf THEN 'PWF' "
    "WHEN osf THEN 'OSF' WHEN hdf THEN 'HDF' END"
)
CODE = "CASE failure_type " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(MODES)) + " END"


def name_of(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODES)) + " END"


CTES = {
    "draws": """
        SELECT event_id AS udi, ts AS created_at FROM events""",
    "measured": f"""
        SELECT udi, created_at,
            CASE WHEN {u('type')} < 0.6e0 THEN 'L' WHEN {u('type')} < 0.9e0 THEN 'M' ELSE 'H' END AS type,
            floor((300 + 4 * {centred('air')}) * 10) / 10 AS air_temp_k,
            floor((310 + 4 * {centred('air')} + 2 * {centred('pr')}) * 10) / 10 AS process_temp_k,
            CAST(floor(1540 + 360 * {centred('rpm')}) AS INTEGER) AS rotational_speed_rpm,
            floor(greatest(0e0, 40 + 20 * {centred('tq')}) * 10) / 10 AS torque_nm,
            CAST(floor({u('wear')} * 254) AS INTEGER) AS tool_wear_min
        FROM draws""",
    "ruled": f"""
        SELECT *, {WEAR} AND {u('twf')} < 0.05e0 AS twf, {HDF} AS hdf, {PWF} AS pwf, {OSF} AS osf,
            {u('rnf')} < 0.002e0 AS rnf
        FROM (SELECT *, {physics()} FROM measured)""",
    "readings": f"""
        SELECT udi, type || lpad(CAST(udi % 100000 AS VARCHAR), 5, '0') AS product_id, {cols(*RAW)},
            twf OR hdf OR pwf OR osf OR {u('unx')} < 0.001e0 AS machine_failure,
            twf, hdf, pwf, osf, rnf, created_at
        FROM ruled""",
    "features": f"SELECT *, {physics()}, {LABEL} AS failure_type FROM readings",
    "training": f"""
        SELECT udi, {cols(*FEATURES)}, failure_type FROM features WHERE failure_type IS NOT NULL""",
    "weighted": f"""
        SELECT udi, created_at, {cols(*FEATURES)}, failure_type,
            CASE WHEN failure_type = 'no_failure' THEN 0.55e0 + {u('w0')} ELSE 0.04e0 * {u('w0')} END AS w0,
            CASE WHEN {WEAR} THEN 0.35e0 * {u('w1')} ELSE 0.01e0 * {u('w1')} END AS w1,
            CASE WHEN temp_diff_k < 8.7e0 AND rotational_speed_rpm < 1390
                THEN 0.5e0 + 0.5e0 * {u('w2')} ELSE 0.01e0 * {u('w2')} END AS w2,
            CASE WHEN power_w < 3550 OR power_w > 8950
                THEN 0.5e0 + 0.5e0 * {u('w3')} ELSE 0.01e0 * {u('w3')} END AS w3,
            CASE WHEN strain_min_nm > 11500 THEN 0.3e0 + 0.5e0 * {u('w4')} ELSE 0.01e0 * {u('w4')} END AS w4
        FROM features WHERE failure_type IS NOT NULL""",
    "scored": f"""
        SELECT udi, created_at, {cols(*FEATURES)}, failure_type, {CODE} AS y,
            w0 / t AS p0, w1 / t AS p1, w2 / t AS p2, w3 / t AS p3, w4 / t AS p4
        FROM (SELECT *, w0 + w1 + w2 + w3 + w4 AS t FROM weighted)""",
    "topped": """
        SELECT *, CASE WHEN p0 = best THEN 0 WHEN p1 = best THEN 1 WHEN p2 = best THEN 2
                       WHEN p3 = best THEN 3 ELSE 4 END AS pred
        FROM (SELECT *, greatest(p0, p1, p2, p3, p4) AS best FROM scored)""",
    "second": """
        SELECT *, CASE WHEN pred <> 0 AND p0 = next THEN 0 WHEN pred <> 1 AND p1 = next THEN 1
                       WHEN pred <> 2 AND p2 = next THEN 2 WHEN pred <> 3 AND p3 = next THEN 3
                       ELSE 4 END AS runner
        FROM (SELECT *, greatest(
                  CASE WHEN pred = 0 THEN -1e0 ELSE p0 END, CASE WHEN pred = 1 THEN -1e0 ELSE p1 END,
                  CASE WHEN pred = 2 THEN -1e0 ELSE p2 END, CASE WHEN pred = 3 THEN -1e0 ELSE p3 END,
                  CASE WHEN pred = 4 THEN -1e0 ELSE p4 END) AS next FROM topped)""",
    "tiered": f"""
        SELECT *, 1e0 - p0 AS score, CASE WHEN pred <> 0 THEN 'high'
            WHEN 1e0 - p0 > {LOG_THRESHOLD} THEN 'elevated' ELSE 'low' END AS risk_tier
        FROM second""",
    "log": f"""
        SELECT udi, md5('req:' || CAST(udi AS VARCHAR)) AS request_id, created_at,
            'failure-classifier' AS model_name, 1 AS model_version, {cols(*FEATURES)},
            p0 AS p_no_failure, p1 AS p_twf, p2 AS p_hdf, p3 AS p_pwf, p4 AS p_osf,
            {name_of('pred')} AS predicted_mode, {name_of('runner')} AS runner_up_mode,
            score AS confidence_score, {LOG_THRESHOLD} AS elevated_threshold, risk_tier
        FROM tiered""",
    "budgeted": f"""
        SELECT healthy AS n_healthy, high AS n_healthy_high,
            CAST(floor({BUDGET} * healthy) AS BIGINT) AS budget,
            CAST(floor({BUDGET} * healthy) AS BIGINT) - high AS room
        FROM (SELECT count(*) AS healthy, count(*) FILTER (WHERE pred <> 0) AS high
              FROM topped WHERE y = 0)""",
    "chosen": """
        SELECT b.*, r.score AS threshold FROM budgeted b
        JOIN (SELECT 1e0 - p0 AS score, row_number() OVER (ORDER BY 1e0 - p0 DESC) AS rn
              FROM topped WHERE y = 0 AND pred = 0) r ON r.rn = b.room + 1""",
    "budget_tiers": """
        SELECT s.*, CASE WHEN pred <> 0 THEN 'high' WHEN 1e0 - p0 > threshold THEN 'elevated'
            ELSE 'low' END AS tier
        FROM second s, chosen""",
    "tiers": "SELECT * FROM (VALUES ('low'), ('elevated'), ('high')) t(risk_tier)",
    "modes": "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{m}')" for k, m in enumerate(MODES))
    + ") t(k, mode)",
    # splits
    "class_n": f"""
        SELECT failure_type, {CODE} AS k, count(*) AS n FROM training GROUP BY failure_type""",
    "quota": """
        SELECT failure_type, n, (n_train * n) // total + CASE WHEN
            row_number() OVER (ORDER BY (n_train * n) % total DESC, k)
            <= n_train - CAST(sum((n_train * n) // total) OVER () AS BIGINT)
            THEN 1 ELSE 0 END AS n_tr
        FROM class_n, (SELECT CAST(sum(n) AS BIGINT) AS total,
            CAST(sum(n) AS BIGINT) - CAST(ceil(0.2e0 * sum(n)) AS BIGINT) AS n_train FROM class_n)""",
    "split": f"""
        SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY failure_type
            ORDER BY md5('{SEED}:' || CAST(udi AS VARCHAR)), udi) <= n_tr
            THEN 'train' ELSE 'test' END AS split
        FROM training t JOIN quota USING (failure_type)""",
    "train_part": "SELECT * FROM split WHERE split = 'train'",
}


def folds_of(source: str) -> dict[str, str]:
    """Folds over any table with udi and failure_type."""
    return {
        "ranked": f"""
            SELECT *, row_number() OVER (PARTITION BY failure_type
                ORDER BY md5('fold-{SEED}:' || CAST(udi AS VARCHAR)), udi) AS in_class,
                row_number() OVER (ORDER BY {CODE}, udi) - 1 AS pos
            FROM {source}""",
        "dealt": """
            SELECT c.failure_type, f, (SELECT count(*) FROM ranked p
                WHERE p.failure_type = c.failure_type AND p.pos % 5 <= f) AS upto
            FROM (SELECT DISTINCT failure_type FROM ranked) c, range(5) r(f)""",
        "folded": """
            SELECT r.*, CAST((SELECT count(*) FROM dealt d WHERE d.failure_type = r.failure_type
                AND d.upto < r.in_class) AS INTEGER) AS fold
            FROM ranked r""",
    }


CHAIN = {
    "readings": ("draws", "measured", "ruled", "readings"),
    "features": ("draws", "measured", "ruled", "readings", "features"),
}
CHAIN["training"] = (*CHAIN["features"], "training")
CHAIN["scored"] = (*CHAIN["features"], "weighted", "scored")
CHAIN["topped"] = (*CHAIN["scored"], "topped")
CHAIN["second"] = (*CHAIN["topped"], "second")
CHAIN["tiered"] = (*CHAIN["second"], "tiered")
CHAIN["log"] = (*CHAIN["tiered"], "log")
CHAIN["chosen"] = (*CHAIN["topped"], "budgeted", "chosen")
CHAIN["budget_tiers"] = (*CHAIN["second"], "budgeted", "chosen", "budget_tiers")
CHAIN["split"] = (*CHAIN["training"], "class_n", "quota", "split")
CHAIN["train_part"] = (*CHAIN["split"], "train_part")
CHAIN["monitored"] = tuple(dict.fromkeys((*CHAIN["log"], *CHAIN["train_part"])))


def sql(chain: str, body: str, more: dict[str, str] | None = None, dims: tuple[str, ...] = ()) -> str:
    parts = [(name, CTES[name]) for name in (*CHAIN[chain], *dims)]
    parts += list((more or {}).items())
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in parts) + " " + body


ORACLES: dict[str, str] = {}
R = READING_COLUMNS

# --- scans, sources and sinks ---------------------------------------------------

ORACLES["csv_scan"] = sql("readings", f"SELECT {cols(*R)} FROM readings")
ORACLES["column_contract"] = sql("readings", f"SELECT {cols(*R)} FROM readings")
ORACLES["training_scan"] = sql("training", "SELECT * FROM training")
ORACLES["readings_schema"] = sql("readings", f"SELECT {cols(*R)} FROM readings")

STAGED = f"""SELECT {cols(*[c for c in R if c != 'torque_nm'])},
    CASE WHEN udi % 7 = 0 THEN torque_nm + 0.5e0 ELSE torque_nm END AS torque_nm FROM readings"""
ACTION = "CASE WHEN udi % 10 = 0 THEN 'insert' WHEN udi % 7 = 0 THEN 'update' ELSE 'unchanged' END"
ORACLES["upsert_diff"] = sql(
    "readings", f"SELECT {ACTION} AS action, count(*) AS n_rows FROM readings GROUP BY 1"
)
ORACLES["upsert"] = sql("readings", f"SELECT *, {ACTION} AS action FROM ({STAGED})")
ORACLES["rebucket"] = sql(
    "readings", "SELECT count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_changed FROM readings"
)
ORACLES["upsert_rerun"] = sql(
    "readings",
    """SELECT 'load' AS run, count(*) AS n_insert, 0::BIGINT AS n_update, 0::BIGINT AS n_unchanged
       FROM readings WHERE udi % 10 <> 0
       UNION ALL SELECT 'batch', count(*) FILTER (WHERE udi % 10 = 0),
         count(*) FILTER (WHERE udi % 10 <> 0 AND udi % 7 = 0),
         count(*) FILTER (WHERE udi % 10 <> 0 AND udi % 7 <> 0) FROM readings
       UNION ALL SELECT 'rerun', 0, 0, count(*) FROM readings""",
)
_SENT = "SELECT *, udi // 500 AS place, (udi // 500) % 8 = 1 AS changes FROM readings WHERE (udi // 500) % 4 = 1"
ORACLES["ranged_upsert"] = sql(
    "readings",
    """SELECT 'load' AS run, count(*) AS n_insert, 0::BIGINT AS n_update, 0::BIGINT AS n_unchanged,
         0::BIGINT AS n_ranges_read, count(DISTINCT udi // 500) AS n_ranges_written FROM readings WHERE udi % 10 <> 0
       UNION ALL SELECT 'batch', count(*) FILTER (WHERE udi % 10 = 0), count(*) FILTER (WHERE udi % 10 <> 0 AND udi % 7 = 0 AND changes),
         count(*) FILTER (WHERE udi % 10 <> 0 AND NOT (udi % 7 = 0 AND changes)),
         count(DISTINCT place) FILTER (WHERE place IN (SELECT udi // 500 FROM readings WHERE udi % 10 <> 0)),
         count(DISTINCT place) FILTER (WHERE changes AND (udi % 10 = 0 OR udi % 7 = 0)) FROM sent
       UNION ALL SELECT 'rerun', 0, 0, count(*), count(DISTINCT place), 0 FROM sent""",
    {"sent": f"SELECT * FROM ({_SENT}) WHERE udi % 10 <> 0 OR changes"},
)
ORACLES["ranged_rows"] = sql(
    "readings",
    f"""SELECT {cols(*[c for c in R if c != 'torque_nm'])},
        CASE WHEN udi % 7 = 0 AND (udi // 500) % 8 = 1 THEN torque_nm + 0.5e0 ELSE torque_nm END AS torque_nm
        FROM readings WHERE udi % 10 <> 0 OR (udi // 500) % 8 = 1""",
)
ORACLES["feature_view"] = sql(
    "features", f"SELECT {cols(*R, *PHYSICS)}, failure_type FROM features"
)
ORACLES["log_append"] = sql(
    "log", f"SELECT {cols(*LOG_COLUMNS)}, true AS has_id, true AS has_time FROM log"
)
ORACLES["window_scan"] = sql(
    "log", f"SELECT {cols(*FEATURES)}, risk_tier, predicted_mode FROM log WHERE created_at >= {CUTOFF}"
)
ORACLES["reference_scan"] = sql("train_part", f"SELECT {cols(*FEATURES)} FROM train_part")
ORACLES["log_lookup"] = sql(
    "log", "SELECT 1::BIGINT AS n_found, '1' AS batch_id, 1::BIGINT AS n_alike, count(*) AS n_log_rows FROM log"
)
ORACLES["point_lookup"] = sql(
    "log",
    """SELECT r.udi, r.product_id, l.request_id, l.risk_tier, (SELECT count(*) FROM log) AS n_log_rows
       FROM readings r LEFT JOIN log l ON l.udi = r.udi AND l.request_id = md5('req:1')
       WHERE r.udi = 1""",
)

# --- projections and predicates -------------------------------------------------

ORACLES["physics_features"] = sql("features", f"SELECT udi, {cols(*PHYSICS)} FROM features")
ORACLES["model_input"] = sql("features", f"SELECT {cols(*FEATURES)} FROM features")
ORACLES["failure_label"] = sql("features", "SELECT udi, failure_type FROM features")
ORACLES["label_encode"] = sql("training", f"SELECT udi, failure_type, {CODE} AS y FROM training")
ORACLES["label_decode"] = sql("scored", "SELECT udi, y, failure_type AS label FROM scored")
ORACLES["ordinal_encode"] = sql(
    "readings",
    "SELECT udi, type, CASE type WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS type_code FROM readings",
)
ORACLES["physics_rules"] = sql(
    "features", f"SELECT udi, {HDF} AS hdf_rule, {PWF} AS pwf_rule, {OSF} AS osf_rule FROM features"
)
ORACLES["wear_window"] = sql(
    "readings", f"SELECT udi, tool_wear_min FROM readings WHERE {WEAR}"
)
ORACLES["mode_count"] = sql("readings", f"SELECT udi, {N_MODES} AS n_modes FROM readings")
ORACLES["null_safe_distinct"] = sql(
    "readings", "SELECT udi, udi % 7 = 0 AS is_distinct FROM readings WHERE udi % 10 <> 0"
)
ORACLES["healthy_mask"] = sql("tiered", "SELECT udi, y = 0 AS is_healthy FROM tiered")
ORACLES["flag_mask"] = sql("tiered", "SELECT udi, risk_tier <> 'low' AS is_flagged FROM tiered")

# --- data quality ---------------------------------------------------------------

_DIRTY = f"""
    SELECT udi, CASE WHEN udi % 89 = 0 THEN 'BAD' ELSE product_id END AS product_id,
        CASE WHEN udi % 101 = 0 THEN 'X' ELSE type END AS type,
        CASE WHEN udi % 97 <> 0 THEN air_temp_k END AS air_temp_k,
        process_temp_k, rotational_speed_rpm, torque_nm, tool_wear_min,
        machine_failure::INT AS machine_failure,
        CASE WHEN udi % 83 = 0 THEN 2 ELSE twf::INT END AS twf,
        hdf::INT AS hdf, pwf::INT AS pwf, osf::INT AS osf, rnf::INT AS rnf
    FROM readings"""
_RULES = {f"{c}_null": f"{c} IS NULL" for c in R}
_RULES |= {"type_domain": "type NOT IN ('L', 'M', 'H')", "product_id_length": "length(product_id) <> 6"}
_RULES |= {f"{f}_binary": f"{f} NOT IN (0, 1)" for f in FLAGS}
ORACLES["validate_batch"] = sql(
    "readings",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE coalesce({bad}, true)) AS n_bad FROM dirty"
        for rule, bad in _RULES.items()
    )
    + " UNION ALL SELECT 'udi_unique', count(*) - count(DISTINCT udi) FROM dirty",
    {"dirty0": _DIRTY, "dirty": "SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE udi % 61 = 0"},
)
ORACLES["observed_rules"] = ORACLES["validate_batch"]
ORACLES["flags_to_bool"] = sql("readings", f"SELECT udi, {cols(*FLAGS)} FROM readings")
_EXPECTED = (
    "udi:extra_forbidden", "action:extra_forbidden", "air_temp_k:missing", "type:literal_error",
    "rotational_speed_rpm:int_type", "rotational_speed_rpm:int_type", "rotational_speed_rpm:int_type",
    "air_temp_k:float_type", "air_temp_k:finite_number", "air_temp_k:finite_number",
    "air_temp_k:greater_than", "rotational_speed_rpm:greater_than",
    "torque_nm:greater_than_equal", "tool_wear_min:greater_than_equal",
)
EXPECTED = (
    "CASE udi % 100 "
    + " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(_EXPECTED, start=1))
    + " ELSE '' END"
)
ORACLES["validate_reading"] = sql("readings", f"SELECT udi, {EXPECTED} AS violations FROM readings")
ORACLES["validate_typed"] = sql(
    "readings",
    """SELECT udi, concat_ws(',', CASE WHEN udi % 41 = 0 THEN 'type' END,
        CASE WHEN udi % 31 = 0 THEN 'air_temp_k' END,
        CASE WHEN udi % 37 = 0 THEN 'torque_nm' END) AS violations FROM readings""",
)

_FAULTS = {
    "model_version": (1, "0"), "type": (2, "'X'"), "air_temp_k": (3, "0e0"),
    "rotational_speed_rpm": (4, "0"), "torque_nm": (5, "-1e0"), "tool_wear_min": (6, "-1"),
    "p_twf": (7, "1.5e0"), "elevated_threshold": (9, "1.5e0"),
    "risk_tier": (11, "CASE WHEN risk_tier = 'low' THEN 'high' ELSE 'low' END"),
    "confidence_score": (12, "NULL"),
}
_BROKEN = "SELECT udi, " + ", ".join(
    f"CASE WHEN udi % 16 = {_FAULTS[c][0]} THEN {_FAULTS[c][1]} ELSE {c} END AS {c}"
    if c in _FAULTS
    else (
        "CASE WHEN udi % 16 = 8 THEN 'RNF' WHEN udi % 16 = 10 THEN predicted_mode "
        "ELSE runner_up_mode END AS runner_up_mode"
        if c == "runner_up_mode"
        else c
    )
    for c in LOG_COLUMNS
) + " FROM log"
_IN_MODES = "IN ('no_failure', 'TWF', 'HDF', 'PWF', 'OSF')"
_CHECKS = {
    "model_version": "model_version > 0", "type": "type IN ('L', 'M', 'H')",
    "air_temp_k": "air_temp_k > 0", "process_temp_k": "process_temp_k > 0",
    "rotational_speed_rpm": "rotational_speed_rpm > 0", "torque_nm": "torque_nm >= 0",
    "tool_wear_min": "tool_wear_min >= 0",
    **{c: f"{c} BETWEEN 0 AND 1" for c in (*P_COLUMNS, "confidence_score", "elevated_threshold")},
    "predicted_mode": f"predicted_mode {_IN_MODES}", "runner_up_mode": f"runner_up_mode {_IN_MODES}",
    "risk_tier": "risk_tier IN ('low', 'elevated', 'high')",
}
_NAMED = {f"predictions_log_{c}_check": holds for c, holds in _CHECKS.items()}
_NAMED["runner_up_differs"] = "runner_up_mode <> predicted_mode"
_NAMED["tier_matches_rule"] = (
    "risk_tier = CASE WHEN predicted_mode <> 'no_failure' THEN 'high' "
    "WHEN confidence_score > elevated_threshold THEN 'elevated' ELSE 'low' END"
)
_ALL_BROKEN = [f"CASE WHEN NOT ({holds}) THEN '{name}' END" for name, holds in _NAMED.items()]
_ALL_BROKEN += [f"CASE WHEN {c} IS NULL THEN '{c}_not_null' END" for c in LOG_COLUMNS]
_SORTED = sorted(_ALL_BROKEN, key=lambda case: case.split("'")[-2])
ORACLES["check_constraints"] = sql(
    "log",
    f"SELECT udi, concat_ws(',', {', '.join(_SORTED)}) AS violations FROM broken",
    {"broken": _BROKEN},
)
ORACLES["constraint_counts"] = sql(
    "log",
    f"""SELECT rule, count(*) AS n_rows
        FROM (SELECT unnest([{', '.join(_ALL_BROKEN)}]) AS rule FROM broken)
        WHERE rule IS NOT NULL GROUP BY rule""",
    {"broken": _BROKEN},
)
ORACLES["response_consistency"] = sql(
    "log",
    """SELECT request_id, concat_ws(',',
         CASE WHEN flagged <> (tier <> 'low') THEN 'flagged_matches_tier' END,
         CASE WHEN (tier = 'high') <> (predicted_mode <> 'no_failure') THEN 'high_matches_mode' END,
         CASE WHEN k % 13 = 0 THEN 'runner_up_differs' END,
         CASE WHEN k % 17 = 0 THEN 'confidence_score_range' END) AS violations
       FROM (SELECT *, CASE WHEN k % 7 = 0 THEN risk_tier = 'low' ELSE risk_tier <> 'low' END AS flagged,
                CASE WHEN k % 11 = 0 THEN 'high' ELSE risk_tier END AS tier
             FROM (SELECT *, CAST('0x' || substr(request_id, 1, 4) AS BIGINT) AS k FROM log))""",
)
_TOTALS = {"rows": "count(*)"}
_TOTALS |= {f"type_{g}": f"count(*) FILTER (WHERE type = '{g}')" for g in "LMH"}
_TOTALS |= {f: f"count(*) FILTER (WHERE {f})" for f in FLAGS}
_TOTALS["null_cells"] = "0::BIGINT"
ORACLES["source_reconciliation"] = sql(
    "readings",
    " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {n} AS n_source, {n} AS n_table, true AS is_equal FROM readings"
        if name != "null_cells"
        else "SELECT 'null_cells', 0::BIGINT, 0::BIGINT, true"
        for name, n in _TOTALS.items()
    ),
)

# --- joins and set comparisons --------------------------------------------------

ORACLES["score_label_join"] = sql(
    "scored", "SELECT udi, 1e0 - p0 AS confidence_score, failure_type FROM scored"
)
ORACLES["score_label_alignment"] = sql(
    "scored",
    """SELECT count(*) FILTER (WHERE udi % 50 <> 0 AND udi % 70 <> 0) AS n_matched,
        count(*) FILTER (WHERE udi % 50 <> 0 AND udi % 70 = 0) AS n_scores_only,
        count(*) FILTER (WHERE udi % 50 = 0 AND udi % 70 <> 0) AS n_labels_only FROM scored""",
)
ORACLES["error_to_reading"] = sql(
    "topped",
    f"""SELECT {cols(*R, of='r')}, {name_of('t.y')} AS "true", {name_of('t.pred')} AS predicted
        FROM topped t LEFT JOIN readings r ON r.udi = t.udi WHERE t.pred <> t.y""",
)
ORACLES["response_in_log"] = sql("log", "SELECT udi, request_id FROM log WHERE udi % 13 = 0")


def matrix(source: str, y: str) -> str:
    return f"""SELECT a.k AS t, b.k AS p, a.mode AS "true", b.mode AS predicted,
        (SELECT count(*) FROM {source} s WHERE {y} = a.k AND s.pred = b.k) AS n
        FROM modes a, modes b"""


ORACLES["reproduction_check"] = sql(
    "topped",
    """SELECT a."true", a.predicted, a.n AS n_recomputed, b.n AS n_logged
       FROM recomputed a JOIN logged b ON a.t = b.t AND a.p = b.p WHERE a.n <> b.n""",
    {
        "recomputed": matrix("topped", "(CASE WHEN s.udi % 40 = 0 THEN 1 ELSE s.y END)"),
        "logged": matrix("topped", "s.y"),
    },
    ("modes",),
)
_REORDERED = physics("rotational_speed_rpm * torque_nm * (2 * pi() / 60)")
ORACLES["parity_check"] = sql(
    "features",
    """SELECT 'served' AS computation, 0::BIGINT AS n_left_only, 0::BIGINT AS n_right_only
       UNION ALL SELECT 'reordered', count(*), count(*)
       FROM features a JOIN moved b ON a.udi = b.udi WHERE a.power_w <> b.power_w""",
    {"moved": f"SELECT udi, {_REORDERED} FROM readings"},
)

_CHANGED = {
    "changed": """SELECT udi, (udi % 101 = 0 OR udi % 97 = 0)::INT::BIGINT AS n_left_only,
        CASE WHEN udi % 101 = 0 THEN 0 ELSE (udi % 97 = 0)::INT + (udi % 103 = 0)::INT END::BIGINT AS n_right_only
        FROM readings WHERE udi % 97 = 0 OR udi % 101 = 0 OR udi % 103 = 0""",
    "hashed": """SELECT udi, sha256('{"udi":' || udi || '}') AS h FROM readings""",
    "nodes": "SELECT DISTINCT l AS level, substr(h, 1, CAST(l AS INTEGER)) AS prefix FROM hashed, range(4) t(l)",
    "hit": """SELECT DISTINCT l AS level, substr(h, 1, CAST(l AS INTEGER)) AS prefix
        FROM hashed JOIN changed USING (udi), range(4) t(l)""",
}
ORACLES["table_diff_rows"] = sql("readings", "SELECT udi, n_left_only, n_right_only FROM changed", _CHANGED)
ORACLES["table_diff_nodes"] = sql(
    "readings",
    """SELECT CAST(n.level AS INTEGER) AS level, count(*) AS n_compared,
        count(*) FILTER (WHERE (n.level, n.prefix) IN (SELECT (level, prefix) FROM hit)) AS n_differing
       FROM nodes n WHERE n.level = 0 OR (n.level - 1, substr(n.prefix, 1, CAST(n.level - 1 AS INTEGER))) IN (SELECT (level, prefix) FROM hit)
       GROUP BY n.level""",
    _CHANGED,
)

# --- aggregates -----------------------------------------------------------------

ORACLES["label_audit_modes"] = sql(
    "readings",
    f"SELECT machine_failure, {N_MODES} AS n_modes, count(*) AS n_rows FROM readings GROUP BY 1, 2",
)
ORACLES["label_audit_multi"] = sql(
    "readings",
    f"""SELECT twf, hdf, pwf, osf, rnf, count(*) AS n_rows FROM readings WHERE {N_MODES} > 1
        GROUP BY ALL""",
)
ORACLES["label_audit_contradictions"] = sql(
    "readings",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE {f} AND NOT machine_failure) AS {f}_without_failure" for f in FLAGS[1:]
    )
    + " FROM readings",
)
ORACLES["label_counts"] = sql(
    "features", "SELECT failure_type, count(*) AS n_rows FROM features GROUP BY 1"
)
ORACLES["spot_check"] = sql(
    "features",
    """SELECT udi, rotational_speed_rpm, torque_nm, air_temp_k, process_temp_k, tool_wear_min,
        round(power_w, 1) AS power_w, round(temp_diff_k, 2) AS temp_diff_k,
        round(strain_min_nm, 1) AS strain_min_nm FROM features WHERE udi = 1""",
)
ORACLES["rule_agreement"] = sql(
    "features",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE {rule}) AS {m}_rule, count(*) FILTER (WHERE {m}) AS {m}_flag, "
        f"count(*) FILTER (WHERE {rule} <> {m}) AS {m}_disagree"
        for m, rule in (("hdf", HDF), ("pwf", PWF), ("osf", OSF))
    )
    + " FROM features",
)
ORACLES["class_share"] = sql(
    "features",
    """SELECT failure_type, count(*) AS n_rows,
        round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM features GROUP BY 1""",
)
ORACLES["class_profile"] = sql(
    "features",
    """SELECT failure_type, round(avg(power_w), 1) AS avg_power_w,
        round(avg(temp_diff_k), 2) AS avg_temp_diff_k, round(avg(strain_min_nm), 1) AS avg_strain_min,
        round(avg(tool_wear_min), 0) AS avg_tool_wear_min,
        round(avg(rotational_speed_rpm), 0) AS avg_rotational_speed,
        round(avg(torque_nm), 1) AS avg_torque FROM features GROUP BY 1""",
)
ORACLES["wear_window_counts"] = sql(
    "features",
    f"""SELECT count(*) FILTER (WHERE {WEAR}) AS in_window,
        count(*) FILTER (WHERE {WEAR} AND twf) AS in_window_twf FROM features""",
)
ORACLES["type_by_class"] = sql(
    "features",
    "SELECT type, "
    + ", ".join(f"count(*) FILTER (WHERE failure_type = '{m}') AS {m.lower()}" for m in MODES)
    + " FROM features GROUP BY type",
)
_SINCE = f"SELECT * FROM log WHERE created_at >= {CUTOFF}"
ORACLES["tier_counts"] = sql(
    "log",
    """SELECT t.risk_tier, count(l.udi) AS n_rows FROM tiers t LEFT JOIN cur l USING (risk_tier)
       GROUP BY 1""",
    {"cur": _SINCE},
    ("tiers",),
)
_SHARES = {t: f"(count(*) FILTER (WHERE risk_tier = '{t}') / CAST(count(*) AS DOUBLE))" for t in ("low", "elevated", "high")}
_FLAGGED = f"({_SHARES['elevated']} + {_SHARES['high']})"
_SHARE_COLUMNS = ", ".join(f"round({s}, 6) AS share_{t}" for t, s in _SHARES.items())
_SHARE_COLUMNS += f", round({_FLAGGED}, 6) AS share_flagged"
ORACLES["tier_shares"] = sql("log", f"SELECT {_SHARE_COLUMNS} FROM cur", {"cur": _SINCE})
ORACLES["class_weights"] = sql(
    "training",
    """SELECT failure_type, n AS n_rows, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6)
        AS weight FROM class_n""",
    dims=("class_n",),
)

# --- selection ------------------------------------------------------------------

ORACLES["kth_largest"] = sql(
    "topped",
    """SELECT b.budget, b.room, r.score AS kth FROM (
         SELECT CAST(floor(f * healthy) AS BIGINT) AS budget, CAST(floor(f * healthy) AS BIGINT) - high AS room
         FROM (VALUES (0.02e0), (0.05e0), (0.10e0)) v(f),
              (SELECT count(*) AS healthy, count(*) FILTER (WHERE pred <> 0) AS high FROM topped WHERE y = 0)) b
       JOIN (SELECT 1e0 - p0 AS score, row_number() OVER (ORDER BY 1e0 - p0 DESC) AS rn
             FROM topped WHERE y = 0 AND pred = 0) r ON r.rn = b.room + 1""",
)
ORACLES["top_two"] = sql(
    "second",
    f"SELECT udi, {name_of('pred')} AS predicted, {name_of('runner')} AS runner_up FROM second",
)

# --- splits and weights ---------------------------------------------------------

ORACLES["stratified_split"] = sql("split", "SELECT udi, failure_type, split FROM split")
ORACLES["stratified_folds"] = sql(
    "train_part", "SELECT udi, failure_type, fold FROM folded", folds_of("train_part")
)
ORACLES["sample_head"] = sql(
    "train_part", f"SELECT udi, {cols(*FEATURES)} FROM train_part ORDER BY udi LIMIT 5"
)
ORACLES["model_save_load"] = sql("split", "SELECT udi, true AS same FROM split WHERE split = 'test'")
ORACLES["oof_proba"] = sql(
    "train_part",
    f"""SELECT udi, {CODE} AS y, fold, 5 AS n_classes, true AS in_range, true AS sums_to_one
        FROM folded""",
    folds_of("train_part"),
)
_UNPIVOTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM train_part" for c in NUMERIC)
ORACLES["shared_bins"] = sql(
    "train_part",
    """SELECT "column", CAST(bin AS INTEGER) AS bin, count(*) AS n_rows, min(value) AS lowest, max(value) AS highest FROM (
        SELECT v."column", v.value, (SELECT count(*) FROM edges e WHERE e."column" = v."column" AND e.value <= v.value) AS bin
        FROM vals v) GROUP BY 1, 2""",
    {
        "vals": _UNPIVOTED,
        "ranked": """SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS r,
            count(*) OVER (PARTITION BY "column") AS n, min(value) OVER (PARTITION BY "column") AS low FROM vals""",
        "edges": """SELECT DISTINCT "column", value FROM ranked JOIN range(1, 64) t(i) ON r = (i * n + 63) // 64
            WHERE value > low""",
    },
)
_GRADE = "CASE type WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END"
for _kind in ("forest", "boosted"):
    ORACLES[f"separable_{_kind}"] = sql(
        "split", f"SELECT udi, {_GRADE} AS grade_code FROM split WHERE split = 'test'"
    )
ORACLES["boosted_rounds"] = sql(
    "train_part",
    """SELECT CAST(r AS INTEGER) AS round, count(*) AS n_rows, round(CAST(count(*) AS DOUBLE), 3) AS total_weight, true AS fell, true AS newton_leaves
       FROM train_part, range(4) t(r) GROUP BY r""",
)
ORACLES["forest_splits"] = sql(
    "train_part",
    """SELECT CAST(l AS INTEGER) AS level, CAST(1 << l AS BIGINT) AS n_nodes, count(*) AS n_rows, true AS gains_match, true AS near_best
       FROM train_part, range(2) t(l) GROUP BY l""",
)
ORACLES["unseen_folds"] = sql(
    "train_part", "SELECT udi, fold, 0e0 AS own_share FROM folded", folds_of("train_part")
)
ORACLES["sample_weights"] = sql(
    "train_part",
    """SELECT udi, round(total / (k * CAST(c AS DOUBLE)), 6) AS weight
       FROM (SELECT udi, count(*) OVER () AS total, count(*) OVER (PARTITION BY failure_type) AS c
             FROM train_part), (SELECT count(DISTINCT failure_type) AS k FROM train_part)""",
)

# --- evaluation -----------------------------------------------------------------


def f1_table(source: str, by: str = "") -> str:
    """precision, recall, F1, support per class (per `by`), from row-wise comparisons."""
    keys = f"SELECT DISTINCT {by} FROM {source}" if by else "SELECT 1"
    group = f"{by}, " if by else ""
    where = f"s.{by} = g.{by} AND " if by else ""
    return f"""
        SELECT {group}k, mode,
            CASE WHEN called > 0 THEN tp / called ELSE 0 END AS "precision",
            CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
            CASE WHEN support + called > 0 THEN 2 * tp / (support + called) ELSE 0 END AS f1,
            CAST(support AS BIGINT) AS support, called
        FROM (SELECT {'g.' + by + ', ' if by else ''}m.k, m.mode,
                (SELECT CAST(count(*) AS DOUBLE) FROM {source} s WHERE {where}s.y = m.k AND s.pred = m.k) AS tp,
                (SELECT CAST(count(*) AS DOUBLE) FROM {source} s WHERE {where}s.y = m.k) AS support,
                (SELECT CAST(count(*) AS DOUBLE) FROM {source} s WHERE {where}s.pred = m.k) AS called
              FROM modes m, ({keys}) g)"""


def auc_table(source: str, by: str = "") -> str:
    """AUC from mid-ranks (Mann-Whitney)."""
    group = f"{by}, " if by else ""
    long = " UNION ALL ".join(
        f"SELECT {group}{k} AS k, y = {k} AS hit, p{k} AS s FROM {source}" for k in range(5)
    )
    return f"""
        SELECT {group}k, CASE WHEN pos > 0 AND neg > 0
            THEN (ranks - pos * (pos + 1) / 2) / (pos * neg) END AS auc
        FROM (SELECT {group}k, sum(CASE WHEN hit THEN mid ELSE 0 END) AS ranks,
                CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS pos,
                CAST(count(*) FILTER (WHERE NOT hit) AS DOUBLE) AS neg
              FROM (SELECT *, rank() OVER (PARTITION BY {group}k ORDER BY s)
                        + (count(*) OVER (PARTITION BY {group}k, s) - 1) / 2e0 AS mid FROM ({long}))
              GROUP BY {group}k)"""


_FIXED = {"f": f1_table("topped"), "auc": auc_table("topped")}
_FOLDED = {
    **folds_of("topped"),
    "ff": f1_table("folded", "fold"),
    "fauc": auc_table("folded", "fold"),
}
_SUMMARY = """round(avg(f1), 6) AS f1_macro_all,
    round(avg(f1) FILTER (WHERE support > 0 OR called > 0), 6) AS f1_macro_seen,
    round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy"""
ORACLES["cv_scores"] = sql(
    "topped",
    """SELECT round(avg(a), 6) AS cv_f1_macro_mean, round(stddev_pop(a), 6) AS cv_f1_macro_std,
        round(avg(b), 6) AS cv_balanced_accuracy_mean, round(stddev_pop(b), 6) AS cv_balanced_accuracy_std
       FROM (SELECT fold, avg(f1) FILTER (WHERE support > 0 OR called > 0) AS a,
                avg(recall) FILTER (WHERE support > 0) AS b FROM ff GROUP BY fold)""",
    _FOLDED,
    ("modes",),
)
_SCOPE = """mode AS "class", round("precision", 6) AS "precision", round(recall, 6) AS recall,
    round(f1, 6) AS f1, support"""
ORACLES["scope_scores"] = sql(
    "topped",
    f"""SELECT CAST(fold AS VARCHAR) AS scope, {_SCOPE} FROM ff UNION ALL SELECT 'all', {_SCOPE} FROM f""",
    _FOLDED | _FIXED,
    ("modes",),
)
ORACLES["predict_class"] = sql("topped", "SELECT udi, pred FROM topped")
ORACLES["per_class_metrics"] = sql(
    "topped",
    """SELECT mode AS "class", round("precision", 6) AS "precision", round(recall, 6) AS recall,
        round(f1, 6) AS f1, round(auc, 6) AS roc_auc, support FROM f JOIN auc USING (k)""",
    _FIXED,
    ("modes",),
)
ORACLES["ovr_auc"] = sql(
    "topped", """SELECT mode AS "class", round(auc, 6) AS roc_auc FROM modes JOIN auc USING (k)""",
    _FIXED, ("modes",),
)
ORACLES["fold_std"] = sql(
    "topped",
    """SELECT mode AS "class", round(stddev_pop("precision"), 6) AS "precision",
        round(stddev_pop(recall), 6) AS recall, round(stddev_pop(f1), 6) AS f1,
        CASE WHEN count(auc) = count(*) THEN round(stddev_pop(auc), 6) END AS roc_auc
       FROM ff JOIN fauc USING (fold, k) GROUP BY mode""",
    _FOLDED,
    ("modes",),
)
ORACLES["confusion_counts"] = sql(
    "topped", """SELECT "true", predicted, n AS n_rows FROM m""", {"m": matrix("topped", "s.y")}, ("modes",)
)
ORACLES["confusion_normalised"] = sql(
    "topped",
    """SELECT "true", predicted, round(coalesce(n / nullif(CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE), 0), 0), 6)
        AS share FROM m""",
    {"m": matrix("topped", "s.y")},
    ("modes",),
)
ORACLES["false_alarms"] = sql(
    "topped", "SELECT count(*) FILTER (WHERE y = 0 AND pred <> 0) AS false_alarms FROM topped"
)
_METRIC_ROWS = " UNION ALL ".join(
    f"""SELECT 'oof_{name}_' || mode AS metric, round({column}, 6) AS value FROM f JOIN auc USING (k)"""
    for name, column in (("precision", '"precision"'), ("recall", "recall"), ("f1", "f1"), ("roc_auc", "auc"))
)
ORACLES["metric_long"] = sql("topped", _METRIC_ROWS, _FIXED, ("modes",))
_P_OF = "CASE {0} WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END"
ORACLES["misclassified_rows"] = sql(
    "second",
    f"""SELECT udi, {name_of('y')} AS "true", {name_of('pred')} AS predicted,
        {_P_OF.format('pred')} AS p_predicted, {name_of('runner')} AS runner_up,
        {_P_OF.format('runner')} AS p_runner_up, {_P_OF.format('y')} AS p_true
        FROM second WHERE pred <> y""",
)
ORACLES["summary_scores"] = sql("topped", f"SELECT {_SUMMARY} FROM f", _FIXED, ("modes",))
ORACLES["macro_auc"] = sql(
    "topped",
    """SELECT CASE WHEN count(auc) = count(*) THEN round(avg(auc), 6) END AS roc_auc_macro_strict,
        round(avg(auc), 6) AS roc_auc_macro_defined FROM auc""",
    _FIXED,
    ("modes",),
)
ORACLES["runner_up_hit_rate"] = sql(
    "second",
    """SELECT count(*) AS n_errors, count(*) FILTER (WHERE runner = y) AS n_runner_up,
        round(count(*) FILTER (WHERE runner = y) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS hit_rate
       FROM second WHERE pred <> y AND y <> 0""",
)
ORACLES["error_margin"] = sql(
    "topped",
    f"""SELECT mode, CASE WHEN margin <= 0.05e0 THEN 'near' WHEN margin <= 0.12e0 THEN 'close' ELSE 'far' END AS band,
        count(*) AS n_errors
        FROM (SELECT mode, CASE mode
            WHEN 'HDF' THEN least(abs(temp_diff_k - 8.6e0) / 8.6e0, abs(rotational_speed_rpm - 1380e0) / 1380e0)
            WHEN 'PWF' THEN least(abs(power_w - 3500e0) / 3500e0, abs(power_w - 9000e0) / 9000e0)
            ELSE abs(strain_min_nm - CAST({LIMIT} AS DOUBLE)) / CAST({LIMIT} AS DOUBLE) END AS margin
          FROM (SELECT *, CASE WHEN y IN (2, 3, 4) THEN {name_of('y')} WHEN pred IN (2, 3, 4) THEN {name_of('pred')} END AS mode
                FROM topped WHERE pred <> y) WHERE mode IS NOT NULL)
        GROUP BY 1, 2""",
)
_SINGLE = """UNION ALL SELECT '{0}_false_alarms',
        CAST(count(*) FILTER (WHERE y = 0 AND pred <> 0) AS DOUBLE) FROM topped"""
ORACLES["evaluation_sink"] = sql(
    "topped",
    f"""SELECT metric, value, 'cv' AS run_id FROM ({_METRIC_ROWS} {_SINGLE.format('oof')}
        UNION ALL SELECT 'oof_roc_auc_macro',
            CASE WHEN count(auc) = count(*) THEN round(avg(auc), 6) END FROM auc)
        UNION ALL SELECT metric, value, 'sealed' FROM ({_METRIC_ROWS.replace("'oof_", "'test_")}
        {_SINGLE.format('test')}
        UNION ALL SELECT 'test_roc_auc_macro', round(avg(auc), 6) FROM auc
        UNION ALL SELECT 'test_f1_macro', round(avg(f1), 6) FROM f
        UNION ALL SELECT 'test_balanced_accuracy',
            round(avg(recall) FILTER (WHERE support > 0), 6) FROM f)""",
    _FIXED,
    ("modes",),
)
_RUNS = "(VALUES ('cv'), ('sealed')) runs(run_id)"
ORACLES["evaluation_matrices"] = sql(
    "topped",
    f"""SELECT run_id, "true", predicted, n AS n_rows, round(coalesce(
        n / nullif(CAST(sum(n) OVER (PARTITION BY run_id, t) AS DOUBLE), 0), 0), 6) AS share FROM m, {_RUNS}""",
    {"m": matrix("topped", "s.y")},
    ("modes",),
)
ORACLES["evaluation_errors"] = sql(
    "second",
    f"""SELECT run_id, udi, {name_of('y')} AS "true", {name_of('pred')} AS predicted,
        {_P_OF.format('pred')} AS p_predicted, {name_of('runner')} AS runner_up,
        {_P_OF.format('runner')} AS p_runner_up, {_P_OF.format('y')} AS p_true
        FROM second, {_RUNS} WHERE pred <> y""",
)

# --- risk tiers -----------------------------------------------------------------

ORACLES["confidence_score"] = sql("scored", "SELECT udi, 1e0 - p0 AS confidence_score FROM scored")
ORACLES["assign_tiers"] = sql("tiered", "SELECT udi, risk_tier FROM tiered")
ORACLES["choose_threshold"] = sql(
    "chosen", "SELECT budget, n_healthy, n_healthy_high, room, threshold FROM chosen"
)
ORACLES["tier_report"] = sql(
    "budget_tiers",
    "SELECT t.risk_tier, "
    + ", ".join(f"count(*) FILTER (WHERE b.y = {k}) AS {m.lower()}" for k, m in enumerate(MODES))
    + " FROM tiers t LEFT JOIN budget_tiers b ON b.tier = t.risk_tier GROUP BY 1",
    dims=("tiers",),
)
_HIT = """count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n_failures,
    round(count(*) FILTER (WHERE y <> 0) / CAST(count(*) AS DOUBLE), 6) AS hit_rate"""
ORACLES["tier_hit_rate"] = sql(
    "budget_tiers",
    f"""SELECT tier AS risk_tier, {_HIT} FROM budget_tiers GROUP BY 1
        UNION ALL SELECT 'all', {_HIT} FROM budget_tiers""",
)
ORACLES["flag_counts"] = sql(
    "budget_tiers",
    """SELECT count(*) FILTER (WHERE tier <> 'low' AND y = 0) AS healthy_flagged,
        count(*) FILTER (WHERE tier <> 'low' AND y = 1) AS twf_flagged FROM budget_tiers""",
)
ORACLES["recommend"] = sql(
    "tiered",
    f"""SELECT md5('req:' || CAST(udi AS VARCHAR)) AS request_id,
        strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
        'failure-classifier' AS model_name, 1 AS model_version, risk_tier <> 'low' AS flagged, risk_tier,
        score AS confidence_score, {name_of('pred')} AS predicted_mode,
        {_P_OF.format('pred')} AS predicted_probability, {name_of('runner')} AS runner_up_mode,
        {_P_OF.format('runner')} AS runner_up_probability,
        p0 AS no_failure, p1 AS "TWF", p2 AS "HDF", p3 AS "PWF", p4 AS "OSF", {cols(*PHYSICS)} FROM tiered""",
)

# --- drift and workload ---------------------------------------------------------

_SCENARIOS = {
    "ref": f"SELECT udi, {cols(*FEATURES)} FROM features WHERE udi % 5 <> 0",
    "shifted": f"""SELECT udi, 'healthy' AS scenario, {cols(*RAW)} FROM readings WHERE udi % 5 = 0
        UNION ALL SELECT udi, 'fault', type, air_temp_k + 2e0, {cols(*RAW[2:])} FROM readings WHERE udi % 5 = 0""",
    "cur": f"SELECT *, {physics()} FROM shifted",
}
_LONG = " UNION ALL ".join(
    f"SELECT scenario, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, 0 AS r, 1 AS c FROM cur "
    f"UNION ALL SELECT s, '{c}', CAST({c} AS DOUBLE), 1, 0 FROM ref, (VALUES ('healthy'), ('fault')) x(s)"
    for c in NUMERIC
)
_DRIFT = {
    **_SCENARIOS,
    "long": _LONG,
    "steps": """SELECT scenario, "column", v, sum(r) AS r, sum(c) AS c FROM long GROUP BY ALL""",
    "cdf": """
        SELECT scenario, "column",
            abs(sum(r) OVER w / CAST(sum(r) OVER a AS DOUBLE) - sum(c) OVER w / CAST(sum(c) OVER a AS DOUBLE)) AS gap,
            lead(v) OVER w - v AS width
        FROM steps WINDOW w AS (PARTITION BY scenario, "column" ORDER BY v),
            a AS (PARTITION BY scenario, "column")""",
    "spread": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", stddev_pop({c}) AS std FROM ref" for c in NUMERIC)
    + ")",
    "wass": """
        SELECT scenario, "column", sum(gap * width) / any_value(std) AS score
        FROM cdf JOIN spread USING ("column") GROUP BY 1, 2""",
    "shares": """
        SELECT s AS scenario, g AS type,
            (SELECT count(*) FROM ref WHERE type = g) / (SELECT CAST(count(*) AS DOUBLE) FROM ref) AS p,
            (SELECT count(*) FROM cur WHERE type = g AND scenario = s)
                / (SELECT CAST(count(*) AS DOUBLE) FROM cur WHERE scenario = s) AS q
        FROM (VALUES ('L'), ('M'), ('H')) t(g), (VALUES ('healthy'), ('fault')) x(s)""",
    "js": """
        SELECT scenario, 'type' AS "column", sqrt(greatest(sum(
            CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS score
        FROM shares GROUP BY 1""",
    "scores": "SELECT * FROM wass UNION ALL SELECT * FROM js",
}
ORACLES["wasserstein_drift"] = sql(
    "features", """SELECT scenario, "column", round(score, 6) AS score FROM wass""", _DRIFT
)
ORACLES["js_drift"] = sql(
    "features", """SELECT scenario, "column", round(score, 6) AS score FROM js""", _DRIFT
)
ORACLES["column_verdicts"] = sql(
    "features",
    """SELECT scenario, "column", CASE WHEN "column" = 'type' THEN 'Jensen-Shannon distance'
        ELSE 'Wasserstein distance (normed)' END AS method, 0.1e0 AS threshold,
        round(score, 6) AS score, score >= 0.1e0 AS drifted FROM scores""",
    _DRIFT,
)
ORACLES["profile_verdicts"] = ORACLES["column_verdicts"]
_VERDICT = """CASE WHEN count(*) FILTER (WHERE score >= 0.1e0) > 0 THEN 'drift' ELSE 'no_drift' END"""
_NAMES = """coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE score >= 0.1e0), 'none')"""
ORACLES["dataset_verdict"] = sql(
    "features",
    f"""SELECT scenario, {_VERDICT} AS verdict, count(*) FILTER (WHERE score >= 0.1e0) AS n_drifted,
        {_NAMES} AS drifted_columns FROM scores GROUP BY scenario""",
    _DRIFT,
)
ORACLES["insufficient_data"] = sql(
    "log",
    f"""SELECT rows_of, n_current, CASE WHEN n_current >= {MIN_ROWS} THEN 'enough_data'
            ELSE 'insufficient_data' END AS status
        FROM (SELECT 'log' AS rows_of, count(*) AS n_current FROM log
              UNION ALL SELECT 'day', count(*) FROM log
              WHERE created_at >= {CUTOFF} AND created_at < {CUTOFF} + INTERVAL 1 DAY)""",
)
ORACLES["workload_vs_expected"] = sql(
    "log",
    f"SELECT {_SHARE_COLUMNS}, round({_FLAGGED} / {EXPECTED_FLAGGED}, 6) AS flagged_vs_expected FROM cur",
    {"cur": _SINCE},
)
_LOGGED = {
    **_DRIFT,
    "ref": f"SELECT udi, {cols(*FEATURES)} FROM train_part",
    "shifted": f"""SELECT udi, 'healthy' AS scenario, {cols(*RAW)}, risk_tier FROM log WHERE created_at >= {CUTOFF}
        UNION ALL SELECT udi, 'fault', type, air_temp_k + 2e0, {cols(*RAW[2:])}, risk_tier
        FROM log WHERE created_at >= {CUTOFF}""",
    "loads": f"""SELECT scenario, count(*) AS n_current, {_SHARE_COLUMNS},
        round({_FLAGGED} / {EXPECTED_FLAGGED}, 6) AS flagged_vs_expected FROM cur GROUP BY scenario""",
    "verdicts": f"""SELECT scenario, {_VERDICT} AS verdict,
        count(*) FILTER (WHERE score >= 0.1e0) AS n_drifted, {_NAMES} AS drifted_columns
        FROM scores GROUP BY scenario""",
}
_WINDOW_ROW = f"""'2024-01-20T00:00:00+00:00' AS since,
    (SELECT count(*) FROM ref) AS n_reference, n_current, {MIN_ROWS} AS min_rows,
    share_low, share_elevated, share_high, share_flagged, flagged_vs_expected,
    CASE WHEN n_current >= {MIN_ROWS} THEN verdict ELSE 'insufficient_data' END AS verdict,
    CASE WHEN n_current >= {MIN_ROWS} THEN n_drifted END AS n_drifted,
    CASE WHEN n_current >= {MIN_ROWS} THEN drifted_columns END AS drifted_columns"""
_FROM_WINDOWS = "FROM loads JOIN verdicts USING (scenario)"
ORACLES["drift_window"] = sql("monitored", f"SELECT scenario, {_WINDOW_ROW} {_FROM_WINDOWS}", _LOGGED)
ORACLES["monitor_sink"] = sql(
    "monitored", f"SELECT scenario AS window_id, {_WINDOW_ROW} {_FROM_WINDOWS}", _LOGGED
)
ORACLES["monitor_scores"] = sql(
    "monitored",
    f"""SELECT scenario AS window_id, "column", CASE WHEN "column" = 'type' THEN 'Jensen-Shannon distance'
        ELSE 'Wasserstein distance (normed)' END AS method, 0.1e0 AS threshold, round(score, 6) AS score,
        score >= 0.1e0 AS drifted, score >= 0.1e0 AS listed
        FROM scores JOIN loads USING (scenario) WHERE n_current >= {MIN_ROWS}""",
    _LOGGED,
)
ORACLES["day_profile_verdicts"] = sql(
    "monitored",
    """SELECT "column", CASE WHEN "column" = 'type' THEN 'Jensen-Shannon distance'
        ELSE 'Wasserstein distance (normed)' END AS method, 0.1e0 AS threshold, round(score, 6) AS score, score >= 0.1e0 AS drifted,
        n_current, low, elevated, high
        FROM scores, (SELECT count(*) AS n_current, count(*) FILTER (WHERE risk_tier = 'low') AS low,
            count(*) FILTER (WHERE risk_tier = 'elevated') AS elevated, count(*) FILTER (WHERE risk_tier = 'high') AS high
            FROM shifted WHERE scenario = 'healthy') WHERE scenario = 'healthy'""",
    _LOGGED,
)


def alarm_ctes() -> dict[str, str]:
    sizes = ", ".join(f"({s})" for s in SIZES)
    reference = " UNION ALL ".join(
        f"SELECT size, w, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, 1 AS r, 0 AS c FROM ref, wins "
        f"UNION ALL SELECT size, w, '{c}', CAST({c} AS DOUBLE), 0, 1 FROM members"
        for c in NUMERIC
    )
    return {
        "ref": _SCENARIOS["ref"],
        "pool": f"SELECT udi, {cols(*FEATURES)} FROM features WHERE udi % 5 = 0",
        "wins": f"""SELECT size, w, w // per_lap AS lap, w % per_lap AS slot
            FROM (SELECT size, (SELECT count(*) FROM pool) // size AS per_lap FROM (VALUES {sizes}) s(size)),
                range({WINDOWS}) r(w) WHERE per_lap > 0""",
        "laps": "SELECT DISTINCT size, lap FROM wins",
        "ordered": f"""SELECT size, lap, p.*, (row_number() OVER (PARTITION BY size, lap ORDER BY
            md5('window-{SEED}-' || size || '-' || lap || ':' || udi), udi) - 1) // size AS slot
            FROM pool p, laps""",
        "members": "SELECT w.size, w.w, o.* EXCLUDE (size, lap, slot) FROM wins w JOIN ordered o "
        "ON o.size = w.size AND o.lap = w.lap AND o.slot = w.slot",
        "long": reference,
        "steps": """SELECT size, w, "column", v, sum(r) AS r, sum(c) AS c FROM long GROUP BY ALL""",
        "cdf": """SELECT size, w, "column",
            abs(sum(r) OVER o / CAST(sum(r) OVER a AS DOUBLE) - sum(c) OVER o / CAST(sum(c) OVER a AS DOUBLE)) AS gap,
            lead(v) OVER o - v AS width FROM steps
            WINDOW o AS (PARTITION BY size, w, "column" ORDER BY v), a AS (PARTITION BY size, w, "column")""",
        "spread": _DRIFT["spread"],
        "wass": """SELECT size, w, "column", sum(gap * width) / any_value(std) AS score
            FROM cdf JOIN spread USING ("column") GROUP BY 1, 2, 3""",
        "shares": """SELECT size, w, g AS type,
            (SELECT count(*) FROM ref WHERE type = g) / (SELECT CAST(count(*) AS DOUBLE) FROM ref) AS p,
            count(m.udi) FILTER (WHERE m.type = g) / CAST(size AS DOUBLE) AS q
            FROM members m, (VALUES ('L'), ('M'), ('H')) t(g) GROUP BY 1, 2, 3""",
        "js": """SELECT size, w, 'type' AS "column", sqrt(greatest(sum(
            CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS score
            FROM shares GROUP BY 1, 2""",
        "alarms": """SELECT size, w, bool_or(score >= 0.1e0) AS alarm
            FROM (SELECT * FROM wass UNION ALL SELECT * FROM js) GROUP BY 1, 2""",
    }


ORACLES["false_alarm_rate"] = sql(
    "features",
    f"""SELECT s.size AS window_size, count(alarm) AS n_windows, count(*) FILTER (WHERE alarm) AS n_alarms,
        CASE WHEN count(alarm) > 0 THEN count(*) FILTER (WHERE alarm) / CAST(count(alarm) AS DOUBLE) END AS rate
        FROM (VALUES {", ".join(f"({s})" for s in SIZES)}) s(size) LEFT JOIN alarms USING (size) GROUP BY 1""",
    alarm_ctes(),
)
ORACLES["mode_counts"] = sql(
    "log",
    """SELECT m.mode AS predicted_mode, count(l.udi) AS n_rows FROM modes m
       LEFT JOIN cur l ON l.predicted_mode = m.mode GROUP BY 1""",
    {"cur": _SINCE},
    ("modes",),
)

# --- integrity and streaming ----------------------------------------------------

ORACLES["fingerprint"] = sql(
    "split",
    """SELECT variant, (SELECT count(*) FROM split WHERE split = 'test') AS n_rows, matches
       FROM (VALUES ('as_is', true), ('shuffled', true), ('nudged', false)) v(variant, matches)""",
)
_W = (
    "1e0",
    f"CASE WHEN {WEAR} THEN 0.6e0 ELSE 0.01e0 END",
    f"CASE WHEN {HDF} THEN 2e0 ELSE 0.02e0 END",
    f"CASE WHEN {PWF} THEN 3e0 ELSE 0.03e0 END",
    f"CASE WHEN {OSF} THEN 2.5e0 ELSE 0.05e0 END",
)
_RULE_SCORED = {
    "ruled_w": "SELECT udi, " + ", ".join(f"{w} AS w{k}" for k, w in enumerate(_W))
    + " FROM features WHERE udi % 100 NOT BETWEEN 1 AND 14",
    "scored": "SELECT udi, " + ", ".join(f"w{k} / t AS p{k}" for k in range(5))
    + " FROM (SELECT *, w0 + w1 + w2 + w3 + w4 AS t FROM ruled_w)",
    "topped": CTES["topped"],
    "second": CTES["second"],
}
ORACLES["stream_score"] = sql(
    "features",
    f"""SELECT CASE WHEN pred <> 0 THEN 'high' WHEN 1e0 - p0 > 0.3e0 THEN 'elevated' ELSE 'low' END AS risk_tier,
        {name_of('pred')} AS predicted_mode, {name_of('runner')} AS runner_up_mode, count(*) AS n_rows,
        round(avg(1e0 - p0), 6) AS avg_confidence FROM second GROUP BY 1, 2, 3""",
    _RULE_SCORED,
)
ORACLES["stream_quarantine"] = sql(
    "readings",
    f"""SELECT violations, count(*) AS n_rows FROM (SELECT {EXPECTED} AS violations FROM readings)
        WHERE violations <> '' GROUP BY 1""",
)
ORACLES["stream_log"] = sql(
    "readings",
    """SELECT count(*) AS n_logged, count(*) AS n_published, 0::BIGINT AS n_missing
       FROM readings WHERE udi % 100 NOT BETWEEN 1 AND 14""",
)
ORACLES["stream_once"] = sql(
    "log",
    """SELECT count(*) + count(*) FILTER (WHERE udi % 3 = 0) AS n_sent, count(*) AS n_logged, count(*) AS n_published FROM log""",
)
ORACLES["stream_late_rows"] = sql(
    "log",
    f"""SELECT strftime(d, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS n_sent,
        count(*) FILTER (WHERE NOT late) AS n_rows, count(*) FILTER (WHERE late) AS n_late,
        count(*) FILTER (WHERE NOT late AND risk_tier = 'elevated') AS n_elevated,
        count(*) FILTER (WHERE NOT late AND risk_tier = 'high') AS n_high,
        count(*) FILTER (WHERE NOT late) > 0 AND d + INTERVAL 1 DAY > (SELECT max(created_at) - INTERVAL 1 HOUR FROM log) AS is_open
       FROM (SELECT *, coalesce(behind, false) AS late FROM (SELECT *, d + INTERVAL 1 DAY <= CASE WHEN udi % 10 = 0
               THEN (SELECT max(created_at) - INTERVAL 1 HOUR FROM log WHERE udi % 10 <> 0)
               WHEN created_at >= {CUTOFF}
               THEN (SELECT max(created_at) - INTERVAL 1 HOUR FROM log WHERE udi % 10 <> 0 AND created_at < {CUTOFF}) END AS behind
             FROM (SELECT *, date_trunc('day', created_at)::TIMESTAMP AS d FROM log))) GROUP BY d""",
)
ORACLES["stream_workload"] = sql(
    "log",
    """SELECT strftime(d, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS n_rows,
        count(*) FILTER (WHERE risk_tier = 'elevated') AS n_elevated,
        count(*) FILTER (WHERE risk_tier = 'high') AS n_high,
        round(count(*) FILTER (WHERE risk_tier <> 'low') / CAST(count(*) AS DOUBLE), 6) AS share_flagged
       FROM (SELECT *, date_trunc('day', created_at)::TIMESTAMP AS d FROM log)
       WHERE d + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM log) GROUP BY d""",
)
