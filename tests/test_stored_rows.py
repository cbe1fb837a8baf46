"""Compact rows of all documents are a compressed table, of which each reader takes a few columns."""

from codeloom.operators import lexical as L
from codeloom.sources import tables as S


def test_rows_of_all_documents_are_stored_compressed(spark):
    docs = S.document_nodes(spark, "/root/testdata/sf0.001")
    files = L.score_corpus(docs, "attion la elle", ["name"]).matches.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
