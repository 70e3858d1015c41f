"""One local session for the suite; every test gets its own folder."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from millwatch.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "8", "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared"))
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf{os.environ.get('MILLWATCH_TEST_SF', '0.001')}"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
