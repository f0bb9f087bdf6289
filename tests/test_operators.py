import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkredact.functions.classify import classify
from sparkredact.operators import geometry, layers, llm_reply, ner, ocr, report
from sparkredact.plans import fixtures

SEGMENTS = "image_id string, seg_idx int, text string, box struct<x: int, y: int, width: int, height: int>, confidence double"


def segments(spark, texts):
    return spark.createDataFrame([("p", i, t, (0, 10 * i, 50, 10), 0.9) for i, t in enumerate(texts)], SEGMENTS)


def test_patterns_and_model_are_united(spark):
    rows = segments(spark, ["user@example.com", "plain words here"])
    model = spark.createDataFrame([("p", 0, ["organization_name"]), ("p", 1, ["person_name", "no such"])], "image_id string, seg_idx int, categories array<string>")
    found = {r.seg_idx: (r.categories, r.fallback) for r in layers.detect(rows, [layers.TableLayer("m", model)]).collect()}
    assert found == {0: (["email", "organization_name", "url"], False), 1: (["person_name"], False)}


def test_unavailable_layers_fall_back_with_one_warning(spark):
    class Broken(layers.Layer):
        @property
        def available(self):
            raise RuntimeError("no")

        def categories(self, segments):
            raise AssertionError

    rows = segments(spark, ["45%", "hello world"])
    found = layers.detect(rows, [Broken(), layers.TableLayer("m", None)])
    assert {r.seg_idx: r.categories for r in found.collect()} == {0: ["percent_value"], 1: []}
    assert [r.warnings for r in layers.warnings_of(found).collect()] == [[layers.FALLBACK_WARNING]]
    off = layers.detect(rows, [Broken()], use_layers=False)
    assert [r.warnings for r in layers.warnings_of(off).collect()] == [[]]


def test_one_layer_available_is_no_fallback(spark):
    rows = segments(spark, ["4111 1111 1111 1111"])
    found = layers.detect(rows, [layers.StructuredLayer(), layers.TableLayer("m", None)]).collect()[0]
    assert "credit_card" in found.categories and not found.fallback
    column = layers.ColumnLayer("c", lambda text: F.when(text.contains("4"), F.array(F.lit("iban"))))
    assert "iban" in layers.detect(rows, [column]).collect()[0].categories


def test_filter_on_categories_runs_patterns_once(spark):
    rows = layers.regions(classify(segments(spark, ["a@b.cc"])))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PRIVATE KEY") == 1


def test_reply_shapes(spark):
    replies = [("a", 2, '```\n{"1":["email"]}\n```'), ("b", 2, '{"-1":["email"],"2":["email"],"0":[]}'), ("c", 2, 'x {"0":["EMAIL ","url"], "1": 5} y'), ("d", 1, '["email"]'), ("e", 1, "{broken")]
    rows = spark.createDataFrame(replies, "image_id string, num_segments int, content string")
    assert sorted((r.image_id, r.seg_idx, r.categories) for r in llm_reply.reply_categories(rows).collect()) == [("a", 1, ["email"]), ("c", 0, ["email", "url"])]


def test_spans_touch_segments(spark):
    pages = spark.createDataFrame(fixtures.PAGES, "image_id string, seg_idx int, text string")
    spans = spark.createDataFrame([("p1", "PERSON", 0.5, 9, 10), ("p1", "PERSON", 0.5, 10, 11)], "image_id string, entity_group string, score double, start int, end int")
    # The space between segments belongs to none; an empty segment inside a span would be touched.
    assert ner.overlapping(pages, spans).collect() == []
    wide = spark.createDataFrame([("p1", "PERSON", 0.5, 0, 30)], spans.schema)
    assert sorted(r.seg_idx for r in ner.overlapping(pages, wide).collect()) == [0, 1, 2]


def test_word_boxes_or_the_line(spark):
    square = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
    schema = "image_id string, width int, height int, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, text_word array<array<string>>, text_word_region array<array<array<array<double>>>>"
    rows = [
        ("words", 99, 99, ["a b c"], [0.5], [square], [["a", " ", "c"]], [[square, square, square]]),
        ("unequal", 99, 99, ["a b"], [None], [square], [["a", "b"]], [[square]]),
        ("bad", 99, 99, ["a b"], [float("nan")], [square], [["a", "b"]], [[square, []]]),
        ("none", 99, 99, [], [], [], [], []),
        ("mixed", 99, 99, ["x", " "], [2.0, 0.1], [square, square], None, None),
    ]
    found = ocr.polygon_segments(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r.image_id, r.seg_idx, r.text, r.confidence) for r in found)
    assert got == [("bad", 0, "a b", 0.0), ("mixed", 0, "x", 1.0), ("unequal", 0, "a b", 0.0), ("words", 0, "a", 0.5), ("words", 1, "c", 0.5)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 500), st.lists(st.tuples(st.floats(-50, 600), st.floats(-50, 600)), min_size=1, max_size=6)), min_size=20, max_size=20))
def test_boxes_are_inside_and_around(spark, cases):
    rows = spark.createDataFrame([(i, quad, w, h) for i, (w, h, quad) in enumerate(cases)], "id int, quad array<struct<x: double, y: double>>, width int, height int")
    for r in rows.select("*", geometry.quad_to_box(F.col("quad"), F.col("width"), F.col("height")).alias("b"), geometry.box_ok(geometry.quad_to_box(F.col("quad"), F.col("width"), F.col("height"))).alias("ok")).collect():
        assert r.ok and r.b.x + r.b.width <= r.width and r.b.y + r.b.height <= r.height
        for x, y in r.quad:
            if 0 <= x <= r.width:
                assert r.b.x - 0.5 <= x <= r.b.x + r.b.width + 0.5


@pytest.mark.parametrize(("given_", "want"), [(0.5, 0.5), (-3.0, 0.0), (7.0, 1.0), (float("nan"), 0.0), (float("inf"), 1.0), (float("-inf"), 0.0), (None, 0.0)])
def test_confidence(spark, given_, want):
    assert spark.createDataFrame([(given_,)], "c double").select(geometry.confidence(F.col("c"))).first()[0] == want


def test_results_and_json(spark):
    found = layers.detect(segments(spark, ["45%", "hello world", "a@b.io"]))
    images = spark.createDataFrame([("p", 64, 48), ("q", 10, 10)], "image_id string, width int, height int")
    rows = report.results(found, images)
    got = {r.image_id: r for r in rows.collect()}
    assert got["p"]["count"] == 2 and [r.text for r in got["p"].regions] == ["45%", "a@b.io"] and got["q"]["count"] == 0
    again = {r.image_id: r for r in report.from_json(report.to_json(rows)).collect()}
    assert again["p"].regions == got["p"].regions and again["q"].regions == []
    assert set(json.loads(report.to_json(rows).filter("image_id = 'p'").first().result)) == {"image_width", "image_height", "count", "regions"}
    labels = {r.image_id: r.label for r in report.count_label(rows).collect()}
    assert labels == {"p": "2 sensitive regions detected", "q": "0 sensitive regions detected"}
    assert report.recall(classify(spark.createDataFrame(fixtures.RECALL, "text string, expected string"))).first().recall >= 0.95


def test_summary_order(spark):
    rows = classify(spark.createDataFrame([("45%",), ("5%",), ("a@b.io",)], "text string"))
    assert [(r.category, r.n) for r in report.category_summary(rows).collect()] == [("percent_value", 2), ("email", 1), ("url", 1)]


def test_nested_lines_are_read_whole_or_not_at_all(spark):
    quad = "[[0,0],[9,0],[9,9],[0,9]]"
    rows = [("flat", f'[[{quad},["a b",0.5]],null,[{quad},["c","x"]]]'), ("page", f'[[[{quad},["a",0.25]]]]'), ("bad", f'[[{quad},["a",0.5]],[[],["b",1]]]'), ("empty", "[]"), ("null", "null")]
    df = spark.createDataFrame([(i, 99, 99, b) for i, b in rows], "image_id string, width int, height int, body string")
    got = sorted((r.image_id, r.seg_idx, r.text, r.confidence) for r in ocr.quad_segments(df).collect())
    assert got == [("flat", 0, "a b", 0.5), ("flat", 1, "c", 0.0), ("page", 0, "a", 0.25)]
    assert [r.image_id for r in ocr.quad_errors(df).collect()] == ["bad"]


def test_settings(spark, monkeypatch):
    from sparkredact.plans.settings import settings

    assert settings(spark).passthrough
    monkeypatch.setenv("SPARKREDACT_RECOGNITION", "polygons")
    assert not settings(spark).passthrough
    monkeypatch.setenv("SPARKREDACT_RECOGNITION", "no such")
    with pytest.raises(ValueError):
        settings(spark)
