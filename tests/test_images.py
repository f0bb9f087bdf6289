import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkredact.operators import images, preprocess
from sparkredact.operators.layers import TableLayer
from sparkredact.plans import guard
from sparkredact.sources import uploads

SCHEMA = "image_id string, height int, width int, channels int, data binary"


def decoded_png(raw: bytes) -> np.ndarray:
    """Pixels of a PNG that images.png wrote (filter 0 on every row)."""
    w, h, kind = int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24]), raw[25]
    c = {0: 1, 2: 3, 6: 4}[kind]
    start = raw.index(b"IDAT") + 4
    rows = np.frombuffer(zlib.decompress(raw[start : start + int.from_bytes(raw[start - 8 : start - 4])]), np.uint8).reshape(h, w * c + 1)
    assert not rows[:, 0].any()
    out = rows[:, 1:].reshape(h, w, c)
    return out if c == 1 else out[:, :, [2, 1, 0, *([3] if c == 4 else [])]]


def test_redaction_covers_keeps_and_shapes(spark):
    rng = np.random.default_rng(1)
    made, boxes = {}, {}
    for i in range(12):
        h, w, c = int(rng.integers(8, 64)), int(rng.integers(8, 64)), int(rng.choice([1, 3, 4]))
        made[str(i)] = rng.integers(1, 256, (h, w, c), dtype=np.uint8)
        boxes[str(i)] = []
        for _ in range(i % 4):
            x, y = int(rng.integers(0, w)), int(rng.integers(0, h))
            boxes[str(i)].append((x, y, int(rng.integers(1, w - x + 1)), int(rng.integers(1, h - y + 1))))
    df = spark.createDataFrame([(k, *a.shape, a.tobytes()) for k, a in made.items()] + [("null", None, None, None, None)], SCHEMA)
    regions = spark.createDataFrame([(k, b) for k, own in boxes.items() for b in own], "image_id string, box struct<x: int, y: int, width: int, height: int>")
    for r in images.redact(df, regions).collect():
        if r.image_id == "null":
            assert r.data is None
            continue
        want = made[r.image_id].copy()
        for x, y, w, h in boxes[r.image_id]:
            want[y : y + h, x : x + w] = 0
        assert bytes(r.data) == want.tobytes() and (r.height, r.width, r.channels) == want.shape


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png(c):
    image = np.random.default_rng(c).integers(0, 256, (7, 5, c), dtype=np.uint8)
    assert np.array_equal(decoded_png(images.png(image)), image)


def test_uploads_are_rows_with_errors_or_pixels(spark, tmp_path):
    alpha = np.zeros((4, 4, 4), np.uint8)
    alpha[:2, :, 2:] = 255
    (tmp_path / "good.png").write_bytes(images.png(np.full((5, 6, 3), 7, np.uint8)))
    (tmp_path / "grey.png").write_bytes(images.png(np.full((5, 6, 1), 9, np.uint8)))
    (tmp_path / "alpha.png").write_bytes(images.png(alpha))
    (tmp_path / "cut.png").write_bytes(images.png(np.zeros((5, 6, 3), np.uint8))[:30])
    (tmp_path / "a.gif").write_bytes(b"GIF89a....")
    (tmp_path / "what").write_bytes(b"\x00\x01")
    (tmp_path / "large.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 5000)
    got = {r.path.rsplit("/", 1)[1]: r for r in uploads.decoded(spark, str(tmp_path), limit=4000).collect()}
    codes = {k: r.error and r.error.code for k, r in got.items()}
    assert codes == {"good.png": None, "grey.png": None, "alpha.png": None, "cut.png": "INVALID_IMAGE", "a.gif": "UNSUPPORTED_FORMAT", "what": "UNSUPPORTED_FORMAT", "large.png": "FILE_TOO_LARGE"}
    assert got["a.gif"].error.detail == "received: GIF" and got["what"].error.detail == "received: unknown" and got["large.png"].error.detail == "size_limit_bytes: 4000"
    assert bytes(got["good.png"].data) == b"\x07" * 90 and bytes(got["grey.png"].data) == b"\x09" * 90
    flat = np.frombuffer(bytes(got["alpha.png"].data), np.uint8).reshape(4, 4, 3)
    assert flat[0, 0].tolist() == [0, 0, 255] and flat[3, 3].tolist() == [255, 255, 255]


def test_quality_gate(spark):
    sizes = [(64, False, True), (412, False, True), (413, True, True), (1000, True, True), (1650, True, False), (1100, True, True)]
    rows = spark.createDataFrame([(h, 200) for h, *_ in sizes], "height int, width int")
    got = {r.height: (r.sufficient, r.upscaled, r.new_height) for r in preprocess.with_quality(rows).collect()}
    assert {h: g[:2] for h, g in got.items()} == {h: (s, u) for h, s, u in sizes}
    assert got[1100][2] == 1650 and got[64][2] == 256
    assert all(r.sufficient and not r.upscaled for r in preprocess.with_quality(rows, passthrough=True).collect())


def bars(angle, h=300, w=220):
    page = np.full((h, w, 1), 255, np.uint8)
    for y in range(60, h - 60, 24):
        page[y : y + 8, 50 : w - 50] = 0
    return preprocess.turned(page, angle)


@pytest.mark.parametrize("angle", [-9.0, -3.0, 0.0, 1.5, 6.0, 12.0])
def test_skew_is_found_and_taken_out(angle):
    page = bars(angle)
    assert abs(preprocess.skew(preprocess.turned(page, preprocess.skew(page)))) <= 1.0


def test_noise_shrinks_and_shape_stays():
    rng = np.random.default_rng(3)
    clean = np.full((40, 40, 4), 120, np.uint8)
    noisy = np.clip(clean.astype(int) + rng.integers(-12, 13, clean.shape), 0, 255).astype(np.uint8)
    out = preprocess.denoised(noisy)
    assert out.shape == noisy.shape and out.dtype == np.uint8 and np.array_equal(out[:, :, 3], noisy[:, :, 3])
    assert np.abs(out[:, :, :3].astype(int) - 120).mean() < np.abs(noisy[:, :, :3].astype(int) - 120).mean()


def test_page_end_to_end(spark):
    white = np.full((64, 64, 3), 255, np.uint8)
    pages = spark.createDataFrame([("a", 64, 64, 3, white.tobytes()), ("b", 64, 64, 3, white.tobytes())], SCHEMA)
    rows = [("a", 0, "user@example.com", (4, 8, 40, 12), 0.9), ("a", 1, "plain words here", (2, 40, 30, 10), 0.9)]
    segments = spark.createDataFrame(rows, "image_id string, seg_idx int, text string, box struct<x: int, y: int, width: int, height: int>, confidence double")
    model = TableLayer("m", spark.createDataFrame([("a", 1, ["person_name"])], "image_id string, seg_idx int, categories array<string>"))
    got = {r.image_id: r for r in guard.process(pages, segments, [model]).collect()}
    a = np.frombuffer(bytes(got["a"].redacted), np.uint8).reshape(64, 64, 3)
    assert not a[8:20, 4:44].any() and not a[40:50, 2:32].any() and a[60, 60].tolist() == [255] * 3
    assert got["a"]["count"] == 2 and got["b"]["count"] == 0 and bytes(got["b"].redacted) == white.tobytes()
    assert guard.process(pages, segments, redact=False).filter("redacted is not null").count() == 0
    poor = {r.image_id: r for r in guard.process(pages, segments, passthrough=False).collect()}
    assert poor["a"]["count"] == 0 and poor["a"].redacted is None and poor["a"].warnings == [preprocess.INSUFFICIENT]
    shown = guard.returned_image(guard.process(pages, segments, [model])).filter("image_id = 'a'").first().base64
    assert np.array_equal(decoded_png(base64.b64decode(shown)), a)
    assert guard.health(spark, [model]).first().status == "ok"


def test_array_rules(spark):
    rows = [(2, 2, 3, b"0" * 12), (2, 2, 2, b"0" * 8), (0, 2, 3, b""), (2, 2, 3, b"0"), (None, 2, 3, b"0")]
    df = spark.createDataFrame(rows, "h int, w int, c int, d binary")
    assert [r[0] for r in df.select(uploads.pixels_ok(F.col("h"), F.col("w"), F.col("c"), F.col("d"))).collect()] == [True, False, False, False, False]


def test_denoising_against_plain_loops():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (12, 14, 1)).astype(np.uint8)
    got = preprocess.denoised(image, 20.0, patch=1, search=2)
    body = image[:, :, 0].astype(float)
    pad = np.pad(body, 2, mode="reflect")
    want = np.zeros_like(body)
    for y in range(12):
        for x in range(14):
            total = weight = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    gap = 0.0
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            a, b = min(max(y + i, 0), 11), min(max(x + j, 0), 13)
                            gap += (body[a, b] - pad[a + 2 + dy, b + 2 + dx]) ** 2 / 9
                    w = np.exp(-gap / 20.0**2)
                    total += w * pad[y + 2 + dy, x + 2 + dx]
                    weight += w
            want[y, x] = total / weight
    assert np.abs(got[:, :, 0] - want).max() <= 0.51


def test_prepared_pages_row_by_row(spark):
    rows = [("w", 450, 120, 1, bytes([255]) * 54_000), ("small", 40, 40, 1, bytes([255]) * 1600)]
    got = {r.image_id: r for r in preprocess.prepared(preprocess.with_quality(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got["w"].height, got["w"].width, set(bytes(got["w"].data))) == (1650, 440, {255}) and got["w"].residual_skew == 0
    assert not got["small"].sufficient and bytes(got["small"].data) == rows[1][4]
