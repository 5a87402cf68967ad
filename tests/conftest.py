import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[4]").appName("matchweave-tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g"))
    session = builder.getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchweave-test-"))
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def one(spark):
    """Value of expressions over a one-row frame of literal columns."""
    from pyspark.sql import functions as F

    def run(*columns, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
        out = row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return out[0] if len(columns) == 1 else tuple(out)

    return run
