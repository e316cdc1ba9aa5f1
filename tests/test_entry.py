"""The entry points with and without the subpackage llm, and the checkpoint folder."""

import os
import subprocess
import sys

import pytest

from parzelle.operators import lineage
from parzelle.queries import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("lost", ["xxhash", "corpus_pipeline", "parzelle.llm"])
def test_core_queries_stay_without_llm(lost):
    code = f"import sys; sys.modules[{lost!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(queries()) and int(out[1]) <= int(out[0]) and out[2] == "False"


def test_no_local_checkpoints_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.durable(Frame())
