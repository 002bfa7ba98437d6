import pytest
from pyspark.sql import SparkSession

from keepset.session import recommended


@pytest.fixture(scope="session")
def spark():
    session = (recommended(SparkSession.builder).master("local[8]").appName("keepset-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def toy(spark):
    rows = [(3, 4, 14, 24, 0.4)] * 4 + [(2, 5, 15, 25, 0.5), (3, 8, 18, 28, 0.6), (100, 200, 1200, 22, 0.5)]
    return spark.createDataFrame(rows, "Unique_ID long, A long, B long, C long, popularity double")
