"""Jobs take the package with them: the executors' Python cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")

RUN = """
import sys
from pathlib import Path
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from postsieve.session import local_session
spark = local_session(cores=4, memory="4g")
spark.sparkContext.setCheckpointDir(str(Path("checkpoint").resolve()))
try:
    spark.range(1).mapInPandas(lambda parts: [__import__("postsieve")], "x int").collect()
    sys.exit("the executors have the package")
except Exception as error:
    assert "No module named 'postsieve'" in str(error), error
bad = []
for name, run in queries().items():
    if name.startswith(("op", "pipeline")):
        try:
            run(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        except Exception as error:
            bad.append((name, str(error)[-800:]))
spark.stop()
sys.exit(str(bad) if bad else 0)
"""


def test_executors_need_no_installed_copy(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != REPO]
    if tokenizers:
        environment["PYTHONPATH"] = ":".join(tokenizers)
    done = subprocess.run(
        [sys.executable, "-c", RUN.format(repo=str(REPO), sf=SF)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900
    )
    assert done.returncode == 0, done.stderr[-3000:]
