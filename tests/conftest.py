import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest tables."""
    return SMALL


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Compares a query with its SQL on the tables of a directory."""
    import glob

    import duckdb

    def run(spark, query, sql, sf_dir=SMALL):
        con = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
        got = query(spark, sf_dir)
        names = sorted(got.columns)
        want = con.sql(sql)
        assert names == sorted(want.columns)
        place = [want.columns.index(n) for n in names]
        left = sorted(repr(tuple(r[n] for n in names)) for r in got.collect())
        right = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
        assert left == right

    return run
