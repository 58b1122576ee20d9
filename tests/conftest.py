import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_parquet(tmp_path):
    """Writes (id, description) files with texts cycled over rows; gives their paths."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name: str, rows: int, texts: list, group: int | None = None) -> str:
        path = str(tmp_path / f"{name}.parquet")
        pq.write_table(pa.table({"id": pa.array(range(rows), pa.int32()), "description": pa.array([texts[i % len(texts)] for i in range(rows)] if texts else [None] * rows, pa.string())}), path, row_group_size=group or rows)
        return path

    return write
