import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd_docs(spark):
    from odd import documents

    return documents(spark).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
