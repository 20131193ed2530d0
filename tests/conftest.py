import sys
from pathlib import Path

import pytest
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postingworks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", "postingworks-tests")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of one expression over a list of inputs."""
    def run(build, values, schema="value string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + schema)
        out = df.select("ord", build(df).alias("out")).orderBy("ord").collect()
        return [r["out"] for r in out]
    return run
