"""Registered queries against their SQL, and the contract's columns."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
import compare
from millwatch.llm import queries

COLUMNS = {
    1: "doc_id n_assign n_access n_hex base_sha256 spans", 2: "doc_id held_out score predicted",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 4: "query_id rank vec_id score",
    5: "doc_id size source_size target taken", 6: "doc_id n_bytes n_removed n_spans kept_sha256",
    7: "doc_id n_lines n_dropped kept_sha256", 8: "query_id rank vec_id score", 9: "doc_id fingerprint component_id",
    10: "page_id warc_type record_id refers_to", 11: "doc_id n_words n_base first_word last_word base_labels labels score",
    12: "doc_id leaf subroot root proof_sha256 folded_root verified",
    13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_every_operator_is_registered_once():
    found = [n for n in driver.queries() if n[:2] == "op" and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == sorted(COLUMNS)
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, given, name):
    connection = compare.oracle_connection(given)
    assert compare.compare(queries.QUERIES[name](spark, given), connection, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_columns_come_first(spark, given, name):
    wanted = COLUMNS[int(name[2:].split("_")[0])].split()
    assert queries.QUERIES[name](spark, given).columns[: len(wanted)] == wanted


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as driver
from millwatch.session import local_session
spark = local_session("2")
for name in sys.argv[3:]:
    driver.queries()[name](spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
"""


def test_workers_need_no_copy_of_the_library(given, tmp_path):
    """The library is on the driver's path alone, and the folder is another one."""
    names = ["op1_secret_scan", "op6_repeats", "op7_line_dedup", "op11_license_notices", "op13_token_alignment"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.abspath(driver.__file__))
    ran = subprocess.run([sys.executable, "-c", ELSEWHERE, root, given, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr[-2000:]
