import pytest

from lumenweave.plans import registry
from tests.conftest import SMALL
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_its_sql(spark, name):
    names, rows = spark_rows(registry.queries()[name](spark, SMALL))
    assert (names, rows) == sql_rows(registry.oracle_sql()[name], SMALL)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"id", "file_path", "score", "rank"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ids_and_prompts_of_whole_texts(spark):
    q = registry.queries()
    assert q["chunk_ids_all"](spark, SMALL).distinct().count() == q["text_chunks"](spark, SMALL).count()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in q["prompt_template_all"](spark, SMALL).collect():
        assert r.document_prompt == f"search_document: {texts[r.doc_id].strip(' ')}" and r.query_prompt == f"search_query: {texts[r.doc_id].strip(' ')}"
