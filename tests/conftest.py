import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from unitscope.session import get_session

    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dense():
    """Cells of a tensor as a dense numpy array."""
    import numpy as np

    def build(mat):
        rows = [tuple(r) for r in mat.select("id_1", "id_2", "id_3", "id_4", "value").collect()]
        ids = np.array([r[:4] for r in rows])
        shape = np.maximum(ids.max(axis=0), 0) + 1
        out = np.full(shape, np.nan)
        for r in rows:
            at = tuple(max(i, 0) for i in r[:4])
            assert np.isnan(out[at]), f"cell {at} twice"
            out[at] = np.nan if r[4] is None else r[4]
        return out

    return build
