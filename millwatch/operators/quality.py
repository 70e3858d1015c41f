"""Contract checks on batches, requests and log rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.session import literal_array


def require_columns(df: DataFrame, wanted, what: str) -> None:
    """Fail with everything that has to be added to or taken from the columns."""
    found = set(df.columns)
    add, drop = sorted(set(wanted) - found), sorted(found - set(wanted))
    if add or drop:
        todo = [f"{verb} {names}" for verb, names in (("add", add), ("drop", drop)) if names]
        raise ValueError(f"{what} does not fit its contract: {', '.join(todo)}")


def column_contract(raw: DataFrame, mapping: Mapping[str, str] = S.CSV_COLUMNS) -> DataFrame:
    """Rename and reorder to the contract."""
    require_columns(raw, mapping, "The header")
    return raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])


def batch_rules() -> dict[str, Column]:
    """Row rules of a staged batch whose flags are still 0/1; true or NULL means bad."""
    columns = tuple(S.CSV_COLUMNS.values())
    rules = {f"{c}_null": F.col(c).isNull() for c in columns}
    rules["type_domain"] = ~F.col("type").isin(*S.GRADES)
    rules["product_id_length"] = F.length("product_id") != 6
    for flag in S.FLAGS:
        rules[f"{flag}_binary"] = ~F.col(flag).isin(0, 1)
    return rules


def _rule_counts() -> list[Column]:
    """Rows that break each row rule; a rule that is NULL is broken."""
    return [F.count_if(F.coalesce(bad, F.lit(True))).alias(rule) for rule, bad in batch_rules().items()]


def _repeated_keys(batch: DataFrame, key: str) -> DataFrame:
    """(rule, n_bad) of uniqueness: the rows beyond the first of each key."""
    return (
        batch.groupBy(key)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"))
        .select(F.lit(f"{key}_unique").alias("rule"), F.col("n_bad").cast("long"))
    )


def validate_batch(batch: DataFrame, key: str = "udi") -> DataFrame:
    """(rule, n_bad) for every rule, whether or not it is broken.

    The row rules are one scan without a shuffle. Uniqueness shuffles the key
    column alone, collapsed on the map side, so a repeated key stays cheap.
    """
    per_rule = batch.agg(*_rule_counts()).unpivot([], list(batch_rules()), "rule", "n_bad")
    return per_rule.unionByName(_repeated_keys(batch, key))


def observed_batch(batch: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows; the action that runs them also counts the row rules.

    Meant for a write right behind the scan: its tasks are then those of a result
    stage, whose counts Spark takes once each, retries and lost executors included.
    Behind a shuffle a stage that runs again could count its rows twice.
    """
    seen = Observation()
    return batch.observe(seen, *_rule_counts()), seen


def written_counts(seen: Observation, written: DataFrame, key: str = "udi") -> DataFrame:
    """(rule, n_bad) as `validate_batch` gives it, from the counts of a finished write.

    Only the key column of what was written is read, for uniqueness. A write of
    no rows counts 0 for each rule.
    """
    counts = [(rule, int(seen.get.get(rule) or 0)) for rule in batch_rules()]
    per_rule = written.sparkSession.createDataFrame(counts, "rule string, n_bad long")
    return per_rule.unionByName(_repeated_keys(written, key))


def require_clean(counts: DataFrame) -> None:
    """Collect every broken rule (a bounded list), then fail once."""
    broken = counts.where("n_bad > 0").orderBy("rule").collect()
    if broken:
        problems = "; ".join(f"{row['rule']} ({row['n_bad']} rows)" for row in broken)
        raise ValueError(f"Batch refused; mend these rows and load it again: {problems}")


def require_valid(batch: DataFrame) -> None:
    require_clean(validate_batch(batch))


def require_unique(batch: DataFrame, key: str) -> None:
    repeated = batch.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][key]} occurs {repeated[0]['n']} times in the batch")


def flags_to_bool(batch: DataFrame) -> DataFrame:
    """0/1 to boolean. Only after validation: a 2 would silently become true."""
    return batch.withColumns({flag: F.col(flag).cast("boolean") for flag in S.FLAGS})


# ---------------------------------------------------------------------------
# Named constraints of the prediction log and of responses
# ---------------------------------------------------------------------------


def table_checks() -> dict[str, Column]:
    """Domains of the readings table."""
    return {
        "readings_type_domain": F.col("type").isin(*S.GRADES),
        "readings_product_id_length": F.length("product_id") == 6,
    }


def _check_name(column: str) -> str:
    return f"{S.LOG_TABLE}_{column}_check"


def log_checks() -> dict[str, Column]:
    """Named CHECKs; each expression states what must hold."""
    checks = {
        _check_name("model_version"): F.col("model_version") > 0,
        _check_name("type"): F.col("type").isin(*S.GRADES),
    }
    for column in ("air_temp_k", "process_temp_k", "rotational_speed_rpm"):
        checks[_check_name(column)] = F.col(column) > 0
    for column in ("torque_nm", "tool_wear_min"):
        checks[_check_name(column)] = F.col(column) >= 0
    for column in (*S.PROBA_COLUMNS, "confidence_score", "elevated_threshold"):
        checks[_check_name(column)] = F.col(column).between(0, 1)
    for column in ("predicted_mode", "runner_up_mode"):
        checks[_check_name(column)] = F.col(column).isin(*S.CLASSES)
    checks[_check_name("risk_tier")] = F.col("risk_tier").isin(*S.TIERS)
    checks["runner_up_differs"] = F.col("runner_up_mode") != F.col("predicted_mode")
    checks["tier_matches_rule"] = F.col("risk_tier") == (
        F.when(F.col("predicted_mode") != S.NO_FAILURE, "high")
        .when(F.col("confidence_score") > F.col("elevated_threshold"), "elevated")
        .otherwise("low")
    )
    return checks


def response_checks() -> dict[str, Column]:
    """What a response can prove on its own."""
    return {
        "flagged_matches_tier": F.col("flagged") == (F.col("risk_tier") != "low"),
        "high_matches_mode": (F.col("risk_tier") == "high")
        == (F.col("predicted_mode") != S.NO_FAILURE),
        "runner_up_differs": F.col("runner_up_mode") != F.col("predicted_mode"),
        "risk_tier_domain": F.col("risk_tier").isin(*S.TIERS),
        **{f"{c}_domain": F.col(c).isin(*S.CLASSES) for c in ("predicted_mode", "runner_up_mode")},
        **{
            f"{c}_range": F.col(c).between(0, 1)
            for c in ("confidence_score", "predicted_probability", "runner_up_probability")
        },
    }


def violations_column(checks: Mapping[str, Column], not_null=()) -> Column:
    """Names of the broken rules. A CHECK passes on NULL; NOT NULL is its own rule."""
    broken = [
        F.when(~F.coalesce(holds, F.lit(True)), F.lit(name)) for name, holds in checks.items()
    ]
    broken += [F.when(F.col(c).isNull(), F.lit(f"{c}_not_null")) for c in not_null]
    return F.array_compact(F.array(*broken))


def annotate(df: DataFrame, checks: Mapping[str, Column], not_null=()) -> DataFrame:
    return df.withColumn("violations", violations_column(checks, not_null))


def annotate_log(df: DataFrame) -> DataFrame:
    return annotate(df, log_checks(), S.LOG_COLUMNS)


def quarantine(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by an annotated `violations` column; persist it before."""
    accepted = annotated.where(F.size("violations") == 0).drop("violations")
    return accepted, annotated.where(F.size("violations") > 0)


def strict(df: DataFrame, checks: Mapping[str, Column], not_null=(), guard: str = "") -> DataFrame:
    """The same rows, but any breach fails the job that writes them, by name.

    The check rides on the `guard` column (the first one by default). As a filter
    it would be pushed below the projections and compute their columns again.
    """
    guard = guard or df.columns[0]
    violations = violations_column(checks, not_null)
    message = F.concat(F.lit("Constraint violated: "), F.array_join(violations, ", "))
    checked = F.when(F.size(violations) == 0, F.col(guard)).otherwise(F.raise_error(message))
    return df.select(*[checked.alias(c) if c == guard else c for c in df.columns])


def violation_counts(annotated: DataFrame) -> DataFrame:
    return (
        annotated.select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("n_rows"))
        .orderBy("rule")
    )


# ---------------------------------------------------------------------------
# Strict request validation on JSON text
# ---------------------------------------------------------------------------

_FLOAT_FIELDS = ("air_temp_k", "process_temp_k", "torque_nm")
_INT_FIELDS = ("rotational_speed_rpm", "tool_wear_min")
_POSITIVE = ("air_temp_k", "process_temp_k", "rotational_speed_rpm")
_INT_LIMIT = 2**31


_VIOLATIONS = "array<struct<field:string,type:string>>"


def _violation(field: str, kind: str) -> Column:
    return F.array(F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type")))


def _field_violation(field: str) -> Column:
    """The first rule a field breaks, as an array of one, or an empty array.

    Reads the `_kind_`, `_text_` and `_number_` columns of the field.
    """
    kind = F.col(f"_kind_{field}")
    found = F.when(kind.isNull(), _violation(field, "missing"))
    if field == "type":
        is_grade = (kind == "STRING") & F.col("_text_type").isin(*S.GRADES)
        found = found.when(~is_grade, _violation(field, "literal_error"))
        return found.otherwise(F.array().cast(_VIOLATIONS))
    number = F.col(f"_number_{field}")
    if field in _INT_FIELDS:
        found = found.when(kind != "BIGINT", _violation(field, "int_type"))
        # An integer beyond 32 bits is a number, but no log row could hold it.
        found = found.when(F.abs(number) >= _INT_LIMIT, _violation(field, "int_parsing_size"))
    else:
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        finite = F.abs(number) < F.lit(float("inf"))
        found = found.when(~is_number, _violation(field, "float_type"))
        found = found.when(~finite, _violation(field, "finite_number"))
    if field in _POSITIVE:
        found = found.when(number <= 0, _violation(field, "greater_than"))
    else:
        found = found.when(number < 0, _violation(field, "greater_than_equal"))
    return found.otherwise(F.array().cast(_VIOLATIONS))


def validate_readings(requests: DataFrame, body: str = "body") -> DataFrame:
    """Parse JSON requests strictly: adds the six inputs and `violations`.

    `violations` is array<struct<field, type>>, fields in request order and then
    unknown keys. A text that is no JSON object, or repeats a key, yields one
    (body, json_invalid). NaN and Infinity are read as numbers so that the field
    can be reported as not finite. Works on batches and streams; rows are neither
    dropped nor reordered.

    A body is parsed once, into a map of variants that keep the JSON type, and
    each field is read once; the rules then work on plain columns. Array functions
    with a lambda are avoided, as they would take the check out of generated code.
    """
    parsed = requests.withColumn(
        "_map", F.from_json(body, "map<string,variant>", {"allowSingleQuotes": "false"})
    )
    keys = F.map_keys("_map")
    is_object = (F.size(keys) == F.size(F.array_distinct(keys))) & F.rtrim(body).endswith("}")
    columns = {"_keys": F.when(is_object, keys)}
    for field in S.RAW_INPUTS:
        value = F.try_element_at("_map", F.lit(field))
        columns[f"_kind_{field}"] = F.schema_of_variant(value)
        if field == "type":
            columns["_text_type"] = F.try_variant_get(value, "$", "string")
        else:
            columns[f"_number_{field}"] = F.try_variant_get(value, "$", "double")
    read = parsed.select(*requests.columns, *[c.alias(name) for name, c in columns.items()])

    names = F.sort_array(F.array_except("_keys", literal_array(S.RAW_INPUTS)))
    kinds = F.array_repeat(F.lit("extra_forbidden"), F.size(names))
    unknown = F.arrays_zip(names, kinds).cast(_VIOLATIONS)
    known = [_field_violation(f) for f in S.RAW_INPUTS]
    checked = F.when(F.col("_keys").isNotNull(), F.concat(*known, unknown))
    inputs = [F.col("_text_type").alias("type")]
    for field in S.REQUEST_SCHEMA.fields[1:]:
        inputs.append(F.col(f"_number_{field.name}").try_cast(field.dataType).alias(field.name))
    return read.select(
        *requests.columns,
        *inputs,
        checked.otherwise(_violation(body, "json_invalid")).alias("violations"),
    )


def reading_checks() -> dict[str, Column]:
    """The same limits on readings that are already typed."""
    checks = {"type": F.col("type").isin(*S.GRADES)}
    for column in S.RAW_INPUTS[1:]:
        finite = ~F.isnan(F.col(column).cast("double")) & (
            F.abs(F.col(column).cast("double")) < F.lit(float("inf"))
        )
        low = F.col(column) > 0 if column in _POSITIVE else F.col(column) >= 0
        checks[column] = finite & low
    return checks
