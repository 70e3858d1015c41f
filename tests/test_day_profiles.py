"""Profiles per log date against the rows themselves."""

import datetime

from pyspark.sql import functions as F

import toys
from millwatch.operators import day_profiles, drift

DAY = datetime.date(2024, 3, 1)


def log_of(spark, day, *torques):
    rows = toys.log_frame(spark, *[{"torque_nm": t, "risk_tier": "high" if t > 50 else "low"} for t in torques])
    return rows.withColumn("log_date", F.lit(DAY + datetime.timedelta(days=day)))


def test_days_add_up_and_a_date_given_again_is_replaced(spark, folder):
    days = [log_of(spark, 0, 40.0, 41.0), log_of(spark, 1, 60.0, 61.0, 60.0), log_of(spark, 2, 20.0)]
    for rows in (log_of(spark, 1, 99.0), *days):
        day_profiles.write_days(rows, folder)
    held = day_profiles.read_days(spark, folder, DAY, DAY + datetime.timedelta(days=1))
    assert tuple(day_profiles.window_load(held).first()) == (5, 2, 0, 3)
    rows = days[0].unionByName(days[1])
    reference = drift.reference_profile(rows.unionByName(days[2]))
    found = {r["column"]: r["score"] for r in drift.wasserstein_between(
        reference.where("value IS NOT NULL"), day_profiles.window_profile(held).where("value IS NOT NULL")
    ).where("column = 'torque_nm'").collect()}
    wanted = drift.wasserstein_drift(rows.unionByName(days[2]), rows, ["torque_nm"]).first()["score"]
    assert abs(found["torque_nm"] - wanted) < 1e-12 and wanted > 0
    none = day_profiles.read_days(spark, folder, DAY - datetime.timedelta(days=9), DAY - datetime.timedelta(days=1))
    assert tuple(day_profiles.window_load(none).first()) == (0, 0, 0, 0)
