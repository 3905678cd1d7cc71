import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from candlewick.session import build_session
    s = build_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cw-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_store_root(tmp_path):
    return str(tmp_path / "store")
