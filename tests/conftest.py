import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


def _alive(session):
    try:
        return session is not None and session.range(1).count() == 1
    except Exception:  # the JVM is gone, or its context
        return False


def _forget():
    """What PySpark keeps of a JVM that is gone."""
    from pyspark import SparkContext
    from pyspark.sql import SparkSession

    SparkContext._gateway = SparkContext._jvm = SparkContext._active_spark_context = None
    SparkSession._instantiatedSession = None


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    """One session for all modules; a module that finds its JVM gone starts another, so a lost one costs one module's tests."""
    from pyspark.sql import SparkSession

    session = SparkSession._instantiatedSession
    if not _alive(session):
        if session is not None:
            _forget()
        memory = os.environ.get("TEST_DRIVER_MEMORY", "2g")  # Spark's own default is 1 GB
        session = SparkSession.builder.master("local[4]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents pages benchmark".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)
