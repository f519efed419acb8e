import pytest
from pyspark.sql import SparkSession

from feedlake.session import configured


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("feedlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("state")))
    )
    session = configured(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over literal inputs: ``value(function, text, …)``."""
    from pyspark.sql import functions as F

    def evaluate(function, *inputs):
        return spark.range(1).select(function(*map(F.lit, inputs)).alias("v")).first()["v"]

    return evaluate
