import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return corpus.table(spark, corpus.rows()).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return corpus.empty(spark)


@pytest.fixture(scope="session")
def given():
    return "/root/testdata/sf0.001"
