import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("KINFOLD_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from kinfold.session import build_session
    scratch = tempfile.mkdtemp(prefix="kinfold-test-")
    s = build_session("local[8]", app="kinfold-tests", shuffle_partitions=8,
                      extra={"spark.local.dir": f"{scratch}/local"})
    # spark.checkpoint.dir comes from the environment when set; otherwise
    # ensure_checkpoint_dir picks a fresh local folder (tests only).
    yield s
    s.stop()
