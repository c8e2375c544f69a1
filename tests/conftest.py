import pytest

from quayside.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("quayside-tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Builder of small tables: ``table("a int, b string", (1, "x"), ...)``."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def without_adaptive(spark):
    """Plans as first made, with no partitions merged at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
