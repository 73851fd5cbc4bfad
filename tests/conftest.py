import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle  # noqa: E402

from semcat.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {}
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        settings["spark.checkpoint.dir"] = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            **settings,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def ship_test_module(request):
    """Test doubles used inside tasks travel by value, as the package does."""
    cloudpickle.register_pickle_by_value(request.module)


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named string inputs."""

    def value(expr_of, **inputs):
        from pyspark.sql import functions as F

        schema = ", ".join(f"{name} {kind}" for name, (kind, _) in inputs.items()) or "x int"
        row = tuple(v for _, v in inputs.values()) or (1,)
        frame = spark.createDataFrame([row], schema)
        return frame.select(expr_of(*[F.col(n) for n in inputs]).alias("v")).first()["v"]

    return value
