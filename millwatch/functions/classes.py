"""Class codes, arg-max, confidence and risk tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.session import literal_array


def _col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def class_code(label: str | Column) -> Column:
    """Index of a class name; an unknown or missing name fails the job, naming it."""
    label = _col(label)
    position = F.array_position(literal_array(S.CLASSES), label)
    unknown = F.raise_error(
        F.concat(F.lit("Unknown class label: "), F.coalesce(label, F.lit("NULL")))
    )
    return F.when(position > 0, position - 1).otherwise(unknown).cast("int")


def class_name(code: str | Column) -> Column:
    """Class name of an index; an index outside the list fails the job."""
    code = _col(code).cast("int")
    inside = code.between(0, len(S.CLASSES) - 1)
    unknown = F.raise_error(
        F.concat(F.lit("Unknown class code: "), F.coalesce(code.cast("string"), F.lit("NULL")))
    )
    return F.when(inside, F.element_at(literal_array(S.CLASSES), code + 1)).otherwise(unknown)


def grade_code(grade: str | Column = "type") -> Column:
    """L, M, H as 0, 1, 2; any other grade fails the job, naming it."""
    grade = _col(grade)
    code = F.array_position(literal_array(S.GRADES), grade)
    unknown = F.raise_error(
        F.concat(F.lit("Unknown grade: "), F.coalesce(grade, F.lit("NULL")))
    )
    return F.when(code > 0, code - 1).otherwise(unknown).cast("int")


def proba_array(columns=S.PROBA_COLUMNS) -> Column:
    return F.array(*[F.col(c) for c in columns])


def checked_proba(proba: str | Column) -> Column:
    """The array itself; a wrong number of classes fails the job."""
    proba = _col(proba)
    wrong = F.raise_error(
        F.concat(
            F.lit(f"A row needs one probability for each of {len(S.CLASSES)} classes; it has "),
            F.coalesce(F.size(proba).cast("string"), F.lit("NULL")),
        )
    )
    return F.when(F.size(proba) == len(S.CLASSES), proba).otherwise(wrong)


def top_code(proba: str | Column) -> Column:
    """Index of the largest probability; the first index wins a tie."""
    proba = _col(proba)
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def runner_up_code(proba: str | Column, top: str | Column) -> Column:
    """Index of the largest probability apart from `top`; never equal to it."""
    proba, top = _col(proba), _col(top)
    masked = F.transform(
        proba, lambda p, i: F.when(i == top, F.lit(float("-inf"))).otherwise(p)
    )
    return (F.array_position(masked, F.array_max(masked)) - 1).cast("int")


def confidence(proba: str | Column) -> Column:
    """1 - P(no_failure): a ranking score, not a frequency."""
    return F.lit(1.0) - F.element_at(checked_proba(proba), 1)


def tier(top: str | Column, score: str | Column, threshold: float | Column) -> Column:
    """high: a failure mode is on top; elevated: score strictly above t; else low."""
    top, score = _col(top), _col(score)
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(top != S.CLASSES.index(S.NO_FAILURE), F.lit("high"))
        .when(score > threshold, F.lit("elevated"))
        .otherwise(F.lit("low"))
    )


def flagged(tier_column: str | Column = "risk_tier") -> Column:
    return _col(tier_column) != "low"


def healthy(code: str | Column = "y") -> Column:
    return _col(code) == S.CLASSES.index(S.NO_FAILURE)
