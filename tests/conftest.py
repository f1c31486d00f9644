import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from gridcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("gridcast-tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def plain_plans_for_small_frames(request, spark):
    """Hand-made frames skip code generation, which costs more than they do.

    The oracle tests run with it, as clusters do.
    """
    small = request.module.__name__ != "test_oracle"
    spark.conf.set("spark.sql.codegen.wholeStage", not small)
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN" if small else "FALLBACK")


@pytest.fixture
def frame(spark):
    """Rows with time text to a DataFrame with TIMESTAMP_NTZ."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema.replace("ts ntz", "ts string"))
        return df.withColumn("ts", df.ts.cast("timestamp_ntz")) if "ts ntz" in schema else df

    return make
