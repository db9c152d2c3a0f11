import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def compare(spark):
    """Whether a query's rows are those of its SQL in DuckDB, columns by name and rows in any order."""
    import duckdb

    def text(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, float):
            return repr(round(x, 6)) if not x.is_integer() else str(int(x))
        return str(x)

    def rows(columns, values):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in values)

    def run(query, sql, sf_dir):
        db = duckdb.connect()
        for path in Path(sf_dir).iterdir():
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            db.execute(f"create view {path.stem} as select * from '{files}'")
        found = query(spark, sf_dir)
        expected = db.execute(sql)
        return rows(found.columns, [tuple(r) for r in found.collect()]), rows([c[0] for c in expected.description], expected.fetchall())

    return run
