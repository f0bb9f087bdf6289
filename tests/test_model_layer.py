import pytest

from sparkredact.operators import layers, model_layer


def test_retries():
    calls, pauses = [], []

    def call(status, until):
        calls.append(status)
        if len(calls) < until:
            raise model_layer.ModelError("no", status)
        return "yes"

    assert model_layer.retried(call, 503, 3, sleep=pauses.append) == "yes" and pauses == [2.0, 4.0]
    for status, n in ((400, 1), (503, 3), (None, 3)):
        calls.clear()
        with pytest.raises(model_layer.ModelError):
            model_layer.retried(call, status, 9, sleep=lambda s: None)
        assert len(calls) == n


def test_chat_layer_and_failed_pages(spark):
    def load():
        def ask(system, prompt):
            if "bad" in prompt:
                raise model_layer.ModelError("no", 400)
            return '{"0": ["person_name"]}'

        return ask

    rows = spark.createDataFrame([("a", 0, "some one"), ("a", 1, None), ("b", 0, "bad 45%"), ("c", 0, " ")], "image_id string, seg_idx int, text string")
    layer = model_layer.ChatLayer(load, pause=0)
    got = {(r.image_id, r.seg_idx): r.categories for r in layers.detect(rows, [layer]).collect()}
    assert got == {("a", 0): ["person_name"], ("a", 1): [], ("b", 0): ["percent_value"], ("c", 0): []}
    assert layer.failures(rows).first().failed_pages == 1
    assert all(c in model_layer.system_prompt() for c in ("iban", "person_name"))


def test_layer_by_segment(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, None)], "image_id string, seg_idx int, text string")
    layer = model_layer.PandasLayer("p", lambda: lambda text: {"iban", "nonsense"})
    assert {r.seg_idx: r.categories for r in layers.detect(rows, [layer]).collect()} == {0: ["iban"], 1: []}


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "image_id string, seg_idx int, text string")


def test_the_only_layer_fails_for_a_page_or_a_segment(spark):
    def load():
        def ask(*args):
            if "bad" in args[-1]:
                raise ValueError("no answer")
            return [{"entity_group": "ORG", "start": 0, "end": 4}] if len(args) == 1 else '{"0": ["iban"]}'

        return ask

    rows = lines(spark, ("a", 0, "Acme"), ("a", 1, "x 45%"), ("b", 0, "bad"), ("b", 1, "45%"), ("c", 0, " "))
    for layer, own in ((model_layer.NerLayer(load, pause=0), "organization_name"), (model_layer.ChatLayer(load, pause=0), "iban")):
        detected = layers.detect(rows, [layer])
        got = {(r.image_id, r.seg_idx): (r.categories, r.fallback) for r in detected.collect()}
        assert got == {("a", 0): ([own], False), ("a", 1): (["percent_value"], False), ("b", 0): ([], True), ("b", 1): (["percent_value"], True), ("c", 0): ([], False)}
        assert {r.image_id: r.warnings for r in layers.warnings_of(detected).collect()} == {"a": [], "b": [layers.FALLBACK_WARNING], "c": []}
    by_segment = layers.detect(rows, [model_layer.PandasLayer("p", lambda: lambda text: {"secret"} if "bad" not in text else 1 / 0)])
    assert {(r.image_id, r.seg_idx): (r.categories, r.fallback) for r in by_segment.collect()}["b", 0] == ([], True)
    # Among several layers one that fails is passed over.
    both = layers.detect(rows, [model_layer.PandasLayer("p", lambda: 1 / 0), layers.ColumnLayer("c", lambda t: layers.F.array(layers.F.lit("url")))])
    assert all("url" in r.categories and not r.fallback for r in both.collect())


def test_row_layers_and_patterns_are_one_projection(spark):
    rows = spark.range(10).selectExpr("cast(id as string) image_id", "0 seg_idx", "'a' text")
    found = layers.detect(rows, [layers.StructuredLayer(), layers.SecretsLayer(), layers.ColumnLayer("c", lambda t: layers.F.array(layers.F.lit("url")))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_entities_that_are_not_usable():
    entities = [{"entity": "per", "start": 0, "end": 1}, {"entity_group": "LOC", "score": "x", "start": 0, "end": 9}, {"entity_group": "LOC", "score": 0.9, "start": 4, "end": 4}, {"entity_group": "URL", "start": 2, "end": 4}, {"entity_group": "person", "start": 3, "end": 4}, 7]
    assert model_layer.segments_of(entities, [0, 5], ["abc", "def"], model_layer.GROUPS, 0.5) == {0: {"url"}}
    assert model_layer.segments_of({"error": "no"}, [0], ["abc"], model_layer.GROUPS, 0.5) == {}


def test_recognition_by_a_client(spark):
    def load():
        def read(h, w, c, data):
            if data == b"\1":
                raise model_layer.ModelError("busy", 503)
            return [("text", (-3, 2, 50, 1), 1.5), ("more",)] if data == b"\2" else [("text", (-3, 2, 50, 1), 1.5)]

        return read

    images = spark.createDataFrame([(i, 5, 9, 1, bytes([k])) for i, k in (("a", 0), ("b", 1), ("c", 2))], "image_id string, height int, width int, channels int, data binary")
    source = model_layer.ClientSource(load, pause=0)
    assert [(r.image_id, r.seg_idx, r.text, tuple(r.box), r.confidence) for r in source.segments(images).collect()] == [("a", 0, "text", (0, 2, 9, 1), 1.0)]
    assert {r.image_id: r.code for r in source.errors(images).collect()} == {"b": "OCR_FAILED", "c": "OCR_FAILED"}
