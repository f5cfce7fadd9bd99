import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfmap.session import get_session
    s = get_session("local[4]", 4, app_name="shelfmap-tests",
                    conf={"spark.ui.showConsoleProgress": "false", "spark.shelfmap.mapEpochs": "10",
                          "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shelfmap-test-ckpt-")})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
