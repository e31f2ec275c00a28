import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plotshift.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4", "6g")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def rings(spark):
    """Build a frame (fid, rings) from lists of point lists; the first list is the outline, others are holes."""

    def make(*polygons):
        rows = [
            (i, None if p is None else [(j > 0, [(float(x), float(y)) for x, y in r]) for j, r in enumerate(p)])
            for i, p in enumerate(polygons)
        ]
        return spark.createDataFrame(
            rows, "fid bigint, rings array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>"
        )

    return make
