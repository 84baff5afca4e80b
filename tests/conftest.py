from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rotorline.session import build_session  # noqa: E402
from rotorline.streaming.detector import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "rotorline-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.sql.streaming.metricsEnabled": "false", STATE_STORE[0]: STATE_STORE[1],
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
