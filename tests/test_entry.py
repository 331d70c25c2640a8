import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
# An executor of its own whose Python workers have no path to this folder: the code can only come from what was shipped.
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.task.maxFailures", "1").getOrCreate()
spark.sparkContext.master = "spark://elsewhere:7077"
entry.ship(spark)
entry.ship(spark)

def where(batches):
    import pyarrow as pa
    from cartograph import session
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"at": [session.__file__]})

print("FROM", spark.range(1).mapInArrow(where, "at string").first().at)
"""


def test_executors_that_start_late_still_get_the_package(tmp_path):
    home = Path(importlib.util.find_spec("pyspark").origin).parent
    (tmp_path / "home/work").mkdir(parents=True)
    for p in home.iterdir():  # executors write their logs to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    (tmp_path / "run.py").write_text(RUN)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path),
    }
    done = subprocess.run([sys.executable, "run.py", str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "cartograph_code.zip" in done.stdout.partition("FROM")[2], done.stderr[-2000:]
    assert not list(tmp_path.glob("cartograph-code-*"))  # gone with the process
