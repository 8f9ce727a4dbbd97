import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_planes(spark):
    """DataFrame of planes from ``{image_id: 2-D array}``."""

    def build(images, dtype="float64"):
        rows = [
            (k, "s", int(a.shape[0]), int(a.shape[1]), dtype, np.asarray(a, float).ravel().tolist())
            for k, a in images.items()
        ]
        return spark.createDataFrame(
            rows,
            "image_id string, stack_id string, height int, width int, dtype string, pixels array<double>",
        )

    return build


@pytest.fixture
def make_masks(spark):
    def build(masks):
        rows = [
            (k, int(m.shape[0]), int(m.shape[1]), np.asarray(m, bool).ravel().tolist())
            for k, m in masks.items()
        ]
        return spark.createDataFrame(rows, "image_id string, height int, width int, mask array<boolean>")

    return build


def disk(shape, cy, cx, r):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return (yy - cy) ** 2 + (xx - cx) ** 2 <= r * r
