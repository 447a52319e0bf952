import pytest

from bizdata.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build("tests", "local[4]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression over one row of named values."""
    def run(build_column, **values):
        names = list(values)
        schema = ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'int' if isinstance(values[n], int) else 'string'}" for n in names)
        df = spark.createDataFrame([tuple(values[n] for n in names)], schema)
        return df.select(build_column.alias("v")).first()["v"]

    return run
