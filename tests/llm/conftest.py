"""Fixtures of documents with nulls, empty and long texts, ties, copies, and an extra column."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_crc32 long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, (langs[k] if langs else "en"), (sources[k] if sources else "s"), len(t or ""), 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make

