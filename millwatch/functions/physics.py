"""Physics features, failure labels and rule flags as column expressions.

The operation order of the three features is part of the contract: a reading
can sit exactly on a rule limit, and another order moves the last bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwatch import schema as S


def power_w(torque: str = "torque_nm", rpm: str = "rotational_speed_rpm") -> Column:
    """Torque times angular speed; pi comes before the division (rpm is an integer)."""
    return F.col(torque) * ((F.col(rpm) * F.lit(2) * F.pi()) / F.lit(60))


def temp_diff_k(process: str = "process_temp_k", air: str = "air_temp_k") -> Column:
    return F.col(process) - F.col(air)


def strain_min_nm(wear: str = "tool_wear_min", torque: str = "torque_nm") -> Column:
    return F.col(wear) * F.col(torque)


def physics_columns() -> list[Column]:
    return [
        power_w().alias("power_w"),
        temp_diff_k().alias("temp_diff_k"),
        strain_min_nm().alias("strain_min_nm"),
    ]


def failure_label() -> Column:
    """One label per row: healthy, the first flagged mode by priority, or NULL."""
    label = F.when(~F.col("machine_failure"), F.lit(S.NO_FAILURE))
    for mode in S.LABEL_PRIORITY:
        label = label.when(F.col(mode.lower()), F.lit(mode))
    return label


def strain_limit(grade: str = "type") -> Column:
    """Overstrain limit of a grade; NULL for an unknown one."""
    limits = S.STRAIN_LIMITS
    return (
        F.when(F.col(grade) == "L", limits["L"])
        .when(F.col(grade) == "M", limits["M"])
        .when(F.col(grade) == "H", limits["H"])
    )


def heat_rule() -> Column:
    return (F.col("temp_diff_k") < S.HEAT_DIFF_LIMIT_K) & (
        F.col("rotational_speed_rpm") < S.HEAT_RPM_LIMIT
    )


def power_rule() -> Column:
    return (F.col("power_w") < S.POWER_LOW_W) | (F.col("power_w") > S.POWER_HIGH_W)


def strain_rule() -> Column:
    return F.col("strain_min_nm") > strain_limit()


def in_wear_window(wear: str = "tool_wear_min") -> Column:
    return F.col(wear).between(*S.WEAR_WINDOW)


def mode_count() -> Column:
    return reduce(lambda a, b: a + b, [F.col(flag).cast("int") for flag in S.MODE_FLAGS])


def relative_margin(value: str | Column, limit) -> Column:
    """Distance of a value to a limit, as a share of the limit."""
    value = F.col(value) if isinstance(value, str) else value
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.abs(value - limit) / limit
