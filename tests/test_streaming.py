import json

import pytest
from pyspark.sql import functions as F

import toys
from catalog.queries import rule_scorer
from millwatch.operators import reconcile
from millwatch.sources import prediction_log
from millwatch.streaming import scoring


def served(scorer=rule_scorer, threshold=0.3):
    return scoring.Served(scorer, threshold, "stub", 3)


def put(folder, name, *bodies):
    import os

    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}.json", "w") as out:
        out.writelines(json.dumps(b) + "\n" for b in bodies)


def run(spark, folder, served_model):
    paths = scoring.StreamPaths(f"{folder}/out")
    requests = scoring.read_requests(spark, f"{folder}/in", files_per_batch=1)
    scoring.start(requests, served_model, paths).awaitTermination()
    return paths


HOT = {**toys.READING, "air_temp_k": 302.0, "process_temp_k": 308.0, "rotational_speed_rpm": 1300}


def test_valid_readings_are_logged_and_published_invalid_ones_are_not(spark, folder):
    put(folder, "1", toys.READING, HOT, {**toys.READING, "action": "stop_machine"})
    put(folder, "2", {**toys.READING, "torque_nm": -1.0, "type": "Q"}, toys.READING)
    paths = run(spark, folder, served())
    log = prediction_log.read_log(spark, paths.log)
    published = spark.read.parquet(paths.published)
    assert (log.count(), published.count()) == (3, 3)
    assert log.select("request_id").distinct().count() == 3
    tiers = {r["predicted_mode"]: r["risk_tier"] for r in log.collect()}
    assert tiers["HDF"] == "high"
    with_threshold = published.withColumn("elevated_threshold", F.lit(0.3))
    assert reconcile.responses_not_logged(with_threshold, log).count() == 0
    rejected = spark.read.parquet(paths.quarantine).collect()
    found = sorted([(v["field"], v["type"]) for v in r["violations"]] for r in rejected)
    assert found == [
        [("action", "extra_forbidden")],
        [("type", "literal_error"), ("torque_nm", "greater_than_equal")],
    ]


def test_later_files_continue_the_stream(spark, folder):
    put(folder, "1", toys.READING)
    run(spark, folder, served())
    put(folder, "2", HOT, HOT)
    paths = run(spark, folder, served())
    assert prediction_log.read_log(spark, paths.log).count() == 3


def test_a_replayed_batch_publishes_the_same_ids(spark, folder):
    paths = scoring.StreamPaths(f"{folder}/out")
    batch = spark.createDataFrame([(json.dumps(toys.READING),), (json.dumps(HOT),)], "body string")
    scoring.process_batch(batch, "s-0", served(), paths)
    before = {r["request_id"] for r in spark.read.parquet(paths.published).collect()}
    scoring.process_batch(batch, "s-0", served(), paths)
    after = {r["request_id"] for r in spark.read.parquet(paths.published).collect()}
    assert before == after and len(after) == 2
    assert prediction_log.read_log(spark, paths.log).count() == 2


def test_nothing_is_published_when_the_log_write_fails(spark, folder):
    """A row that breaks a constraint is a bug: the batch fails, loudly and whole."""
    put(folder, "1", toys.READING)
    bad = lambda inputs: inputs.withColumn(
        "proba", F.array(*[F.lit(x) for x in (1.5, -0.5, 0.0, 0.0, 0.0)]))
    with pytest.raises(Exception, match="predictions_log_p_no_failure_check"):
        run(spark, folder, served(bad))
    paths = scoring.StreamPaths(f"{folder}/out")
    assert prediction_log.read_log(spark, paths.log).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths.published)
    # Once the scorer is mended, the same batch goes through.
    run(spark, folder, served())
    assert spark.read.parquet(paths.published).count() == 1


def test_a_stream_without_its_checkpoint_loses_no_row(spark, folder):
    """Batch numbers start over, batch names do not."""
    put(folder, "1", toys.READING)
    first = run(spark, folder, served())
    put(folder, "1", HOT, HOT)
    again = scoring.StreamPaths(first.root)
    other = type("Elsewhere", (scoring.StreamPaths,), {"checkpoint": f"{folder}/new"})(again.root)
    requests = scoring.read_requests(spark, f"{folder}/in")
    scoring.start(requests, served(), other).awaitTermination()
    assert prediction_log.read_log(spark, first.log).count() == 3


def test_batch_and_stream_score_alike(spark, folder):
    put(folder, "1", toys.READING, HOT)
    paths = run(spark, folder, served())
    rows = [tuple(b.values()) for b in (toys.READING, HOT)]
    schema = "type string, air_temp_k double, process_temp_k double, rotational_speed_rpm int, torque_nm double, tool_wear_min int"
    batch = scoring.score_requests(spark.createDataFrame(rows, schema), served())
    streamed = prediction_log.read_log(spark, paths.log).select(batch.columns)
    assert tuple(reconcile.multiset_difference(batch, streamed).first()) == (0, 0)


def test_a_request_sent_again_is_scored_once(spark, folder):
    """In its own batch, in a later one and after a restart; requests without a key are all kept."""
    import os

    os.makedirs(f"{folder}/keyed")
    paths = scoring.StreamPaths(f"{folder}/out")

    def send(name, *keys):
        lines = [{"request_key": k, "sent_at": "2024-03-01T10:00:00Z", "body": json.dumps(toys.READING)} for k in keys]
        with open(f"{folder}/keyed/{name}.json", "w") as out:
            out.writelines(json.dumps(line) + "\n" for line in lines)
        requests = scoring.scored_once(scoring.read_keyed_requests(spark, f"{folder}/keyed"))
        scoring.start(requests, served(), paths).awaitTermination()
        return prediction_log.read_log(spark, paths.log).count()

    assert send("1", "a", "a", "b", None, None) == 4
    assert send("2", "b", "c", None) == 6
