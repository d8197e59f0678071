import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forgelens import schemas  # noqa: E402
from forgelens.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return SF_DIR


@pytest.fixture(scope="session")
def make_workflows(spark):
    """Workflow table from partial rows; absent columns get empty values."""
    import datetime

    blank = {
        "repo": "acme/app",
        "workflow_name": "ci",
        "crawl_date": datetime.date(2026, 1, 1),
        "uses_matrix": False,
        "uses_reusable_workflows": False,
        "has_permissions_block": False,
        "permissions": None,
        "concurrency_set": False,
        "has_ai_review": False,
        "has_security_scan": False,
    }

    def build(*rows):
        full = []
        for row in rows:
            merged = {**{name: [] for name in schemas.WORKFLOW.names}, **blank, **row}
            for name, prefix in (("workflow_path", ".github/workflows/"), ("source_file", "raw/")):
                merged[name] = row.get(name, f"{prefix}{merged['workflow_name']}.yml")
            full.append(tuple(merged[name] for name in schemas.WORKFLOW.names))
        return spark.createDataFrame(full, schemas.WORKFLOW)

    return build
