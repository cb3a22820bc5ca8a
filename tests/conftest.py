from __future__ import annotations

import pytest

from chainmetrics.session import local_session
from chainmetrics.sources import fixtures
from chainmetrics.sources.schemas import SCHEMAS
from chainmetrics.sources.sinks import write_parquet
from chainmetrics.sources.tables import Sources


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        cores="4",
        partitions=4,
        **{
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A folder with the nine canonical tables as Parquet."""
    root = str(tmp_path_factory.mktemp("tables"))
    src = fixtures.load(spark, "/root/testdata/sf0.001")
    for name in SCHEMAS:
        write_parquet(getattr(src, name), f"{root}/{name}")
    return root


@pytest.fixture
def make(spark):
    """``make(table=[{column: value}, ...])``: sources with the given rows only."""

    def build(**tables) -> Sources:
        frames = {}
        for name, ddl in SCHEMAS.items():
            ddl = ddl.replace(" timestamp", " timestamp_ntz")
            columns = [part.split()[0] for part in ddl.split(",")]
            rows = [tuple(row.get(c) for c in columns) for row in tables.get(name, [])]
            frames[name] = spark.createDataFrame(rows, ddl)
        return Sources.of(**frames)

    return build


def rows_of(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def one(df) -> dict:
    rows = rows_of(df)
    assert len(rows) == 1, rows
    return rows[0]
