"""Card numbers that one character parts: queries return the rows of their SQL, the operators find every number."""

import pytest

from sparkredact.functions.classify import classify
from sparkredact.operators.layers import StructuredLayer, detect
from sparkredact.plans import registry

duckdb = pytest.importorskip("duckdb")

#: Only the second number has its check digit: the SQL looks within it.
SECOND = "Hean. 2353820953013749 4550997810720808 thheed"
#: No number has its check digit; from the middle of one the SQL puts digits together that have.
WITHIN = "8486679862084,4343568344835-0638 7080 4461 4426\t3720 3295 4085 0494 "
DOCUMENTS = [
    (1, SECOND, "en"),
    (2, WITHIN, "de"),
    (3, f"word\n2353820953013749,4550997810720808\n\n{SECOND}", "en"),
    (4, "4111 1111 1111 1111 2353820953013749", "en"),
    (5, "2353820953013749, 4550997810720808", "fr"),
    (6, "2353820953013749", "fr"),
    (7, None, "es"),
]
QUERIES = ["flag_credit_card", "redact_pixels", "layered_detection", "secrets_layer", "clean_docs_anti", "sensitive_docs_semi", "category_summary", "category_by_lang", "debug_table", "result_json_round_trip"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("adjacent")
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in DOCUMENTS], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1,), (9,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "customer"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        yield str(folder), db


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    folder, db = tables
    rows = registry.QUERIES[name](spark, folder)
    wanted = db.execute(f'SELECT {", ".join(f"{chr(34)}{c}{chr(34)}" for c in rows.columns)} FROM ({registry.ORACLES[name]})').fetchall()
    assert wanted and sorted(map(tuple, rows.collect()), key=repr) == sorted(wanted, key=repr)


def test_operators_find_every_number(spark):
    rows = spark.createDataFrame([("a", 0, SECOND), ("a", 1, WITHIN)], "image_id string, seg_idx int, text string")
    found = {r.text: "credit_card" in r.categories for r in classify(rows).collect()}
    assert found == {SECOND: True, WITHIN: False}
    assert {r.text: "credit_card" in r.categories for r in detect(rows, [StructuredLayer()]).collect()} == found
