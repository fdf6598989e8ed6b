from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quire.schemas import FILES


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("quire-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """``files`` table from ``{path: content}`` or ``{(repo, path): content}``."""

    def build(contents: dict, repo: str = "r", kinds: dict | None = None):
        rows = []
        for key, content in contents.items():
            name, path = key if isinstance(key, tuple) else (repo, key)
            raw = content.encode() if isinstance(content, str) else content
            kind = (kinds or {}).get(path, "file")
            rows.append((name, path, raw, len(raw) if raw is not None else 0, kind))
        return spark.createDataFrame(rows, FILES)

    return build
