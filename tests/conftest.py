import pytest

from commentlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(p, t, lang) for p, t, lang in rows], "path string, text string, lang string"
        )

    return make
