import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from structura.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="structura-tests")
    yield s
    s.stop()


def files_df(spark, texts: dict):
    """``file_id, content`` from {file_id: str | bytes}."""
    rows = [(k, v if isinstance(v, bytes) else v.encode("utf-8")) for k, v in texts.items()]
    return spark.createDataFrame(rows, "file_id string, content binary")


def urls_df(spark, urls, site="s"):
    return spark.createDataFrame([(site, i, u) for i, u in enumerate(urls)], "site_id string, pos bigint, url string")
