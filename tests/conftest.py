import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def workspace(spark, tmp_path):
    from framewright.plans import Workspace

    with Workspace(spark, str(tmp_path / "w")) as w:
        yield w


@pytest.fixture
def images(spark):
    """Ten images: a tie of content between 1 and 5, a null caption and an empty one."""
    rows = [(k, f"{k % 9:064x}" if k != 5 else f"{1:064x}", f"/in/p{k}.png", ".png", 100 * k + 100, 600, "PNG" if k % 2 else "WEBP", None if k == 3 else "" if k == 4 else f"cap {k}", float(k % 4)) for k in range(10)]
    return spark.createDataFrame(rows, "_pos long, objectid string, original_path string, ext string, width int, height int, format string, caption string, score double")
