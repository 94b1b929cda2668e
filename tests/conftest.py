import os
import sys
import tempfile
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH", "")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the tables of a folder and returns sorted rows as strings, with the column names."""
    import duckdb

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for f in sorted(os.listdir(sf_dir)):
            name = f.removesuffix(".parquet")
            path = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        return con.execute(sql).fetchdf()

    return run


def comparable(pdf):
    """Rows of a pandas frame as sorted tuples of text; numbers as floats, so integer widths do not matter."""
    cols = sorted(pdf.columns)

    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return cols, sorted(tuple(text(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))
