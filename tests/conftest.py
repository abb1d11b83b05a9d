"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A small local session whose warehouse lies in a temporary folder."""
    from tessera.session import build_session

    folder = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", 4, {
        "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"file://{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
