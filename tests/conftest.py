import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=3, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blobs():
    """Two blobs with a bridge, exact copies, and far points."""
    rng = np.random.default_rng(7)
    a = rng.normal(0, 0.3, (40, 3))
    b = rng.normal(3, 0.3, (35, 3))
    bridge = np.linspace([0.6, 0.6, 0.6], [2.4, 2.4, 2.4], 9)
    copies = np.repeat(a[:1], 20, axis=0)
    far = rng.uniform(-9, -6, (6, 3))
    return np.vstack([a, b, bridge, copies, far]).round(3)


@pytest.fixture(scope="session")
def points(spark, blobs):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(blobs)]
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3).cache()
