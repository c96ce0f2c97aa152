import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def compare(spark_rows, duck_rows):
    """Both as sorted rows of rounded values, by sorted column names."""
    def value(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.4f}".replace("-0.0000", "0.0000")
        return str(v)

    def table(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return [columns[i] for i in order], sorted([value(r[i]) for i in order] for r in rows)

    a, b = table(*spark_rows), table(*duck_rows)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert [x for x, y in zip(a[1], b[1], strict=True) if x != y][:3] == [y for x, y in zip(a[1], b[1], strict=True) if x != y][:3]
