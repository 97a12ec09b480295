from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from contextmill.session import CHECKPOINT_DIR, WORK_DIR, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get(CHECKPOINT_DIR, None):
        session.conf.set(WORK_DIR, str(tmp_path_factory.mktemp("work")))
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Set a session option for one test."""
    before = {}

    def change(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
