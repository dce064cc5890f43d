from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from calzada.session import local_session

    session = local_session("calzada-tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from calzada.registry.fixture import Fixture

    return Fixture(spark, SF_DIR)


@pytest.fixture(scope="session")
def con():
    from compare import duck

    return duck(SF_DIR)
