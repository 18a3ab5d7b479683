import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def docs_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(docs_dir):
    import pyarrow.parquet as pq
    return [(d["doc_id"], d["text"], d["lang"], d["source"])
            for d in pq.read_table(f"{docs_dir}/documents.parquet").to_pylist()]
