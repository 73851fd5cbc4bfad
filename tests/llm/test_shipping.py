"""Jobs bring their functions along: workers need no installed copy of the package."""

import os
import subprocess
import sys

import pytest

from semcat.llm.registry import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# The driver finds the repository by its path; workers start anew, elsewhere, without it.
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import tempfile
import __spark_entry__
from pyspark.sql import functions as F
from semcat.session import build_session

spark = build_session("local[4]", "shipping", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
spark.sparkContext.setLogLevel("OFF")

@F.udf("boolean")
def knows_the_package(x):
    import importlib.util
    return importlib.util.find_spec("semcat") is not None

assert not spark.range(1).select(knows_the_package("id")).first()[0]
for name in sys.argv[3:]:
    try:
        print(name, __spark_entry__.queries()[name](spark, sys.argv[2]).count())
    except Exception as error:
        print(name, "failed", str(error)[-300:].replace(chr(10), " "))
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_run_where_workers_lack_the_package(tmp_path):
    names = [*QUERIES, "q_calls", "q_normalise_calls", "q_embed_hash", "q_topk_batch"]
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO, SF, *names], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    lines = dict(line.split(" ", 1) for line in run.stdout.splitlines() if line.startswith(("op", "pipeline", "q_")))
    assert set(lines) == set(names), run.stderr[-2000:]
    assert {name: said for name, said in lines.items() if not said.isdigit()} == {}
