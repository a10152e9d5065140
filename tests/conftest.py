import os
import sys

import pytest

#: Folder of the smallest tables.
DATA = os.environ.get("FACTLAKE_TESTDATA", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factlake.session import build_session

    s = build_session("tests", cores=4, memory="3g", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
