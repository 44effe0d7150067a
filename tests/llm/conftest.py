from __future__ import annotations

import pytest

from ..conftest import DATA


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


#: Texts that operators must take without crashing.
ODD = [None, "", " ", "\n\n", "a", "word " * 5000, "x" * 20000, "é😀 ß\t\x0b\r\n漢字", "same text of six words here", "same text of six words here", "1 2 3", "<|endoftext|> a"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(1000 + i, t, f"c{i}", i) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, band long")
