import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
