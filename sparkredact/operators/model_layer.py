"""Layers and sources that call a model: one load for a Python worker, whole pages, retries, no failed jobs."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES
from .layers import PageLayer, RowLayer
from .llm_reply import prompts, reply_entries
from .ner import GROUP_SCORE, GROUPS

#: Attempts, seconds of pause for each attempt made, and the statuses that are tried again.
ATTEMPTS, PAUSE, RETRIED = 3, 2.0, (429, 500, 502, 503, 504)


class ModelError(Exception):
    """What a model call raises; status None stands for a call without an answer, which is tried again."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def retried(call: Callable, *args, attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable = time.sleep):
    """call(*args), again after a longer and longer pause where the error may pass."""
    for turn in range(1, attempts + 1):
        try:
            return call(*args)
        except ModelError as error:
            if turn == attempts or error.status is not None and error.status not in RETRIED:
                raise
            sleep(pause * turn)
    return None


def system_prompt() -> str:
    """What a chat model is told before the segments of a page."""
    return (
        "You find sensitive information in numbered text segments of one document page. Judge each segment with the whole page in mind. "
        "Answer with a JSON object alone: the number of a segment as a string, and the list of its labels. Leave out segments without any. "
        "Labels: " + ", ".join(sorted(CATEGORIES)) + "."
    )


class ChatLayer(PageLayer):
    """A chat model asked once for each page; load() gives the function from (system, prompt) to a reply.

    A page whose call fails gives no categories and is marked, so that the patterns stand for it; blank pages aren't asked about.
    """

    name = "chat"

    def __init__(self, load: Callable[[], Callable[[str, str], str]], available: bool = True, pause: float = PAUSE):
        self._load, self._available, self._pause = load, available, pause

    @property
    def available(self) -> bool:
        return self._available

    def replies(self, segments: DataFrame) -> DataFrame:
        """(image_id, num_segments, content, failed) of each page that isn't blank."""
        load, pause = self._load, self._pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = None
            for batch in batches:
                contents, failed = [], []
                for prompt in batch["prompt"]:
                    try:
                        ask = ask or load()
                        contents.append(retried(ask, system_prompt(), prompt, pause=pause))
                        failed.append(False)
                    except Exception:
                        contents.append(None)
                        failed.append(True)
                yield pd.DataFrame({"image_id": batch["image_id"], "num_segments": batch["num_segments"], "content": contents, "failed": failed})

        return prompts(segments).mapInPandas(run, "image_id string, num_segments int, content string, failed boolean")

    def pages(self, segments: DataFrame) -> DataFrame:
        return self.replies(segments).select("image_id", reply_entries(F.col("content"), F.col("num_segments")).alias("found"), "failed")

    def failures(self, segments: DataFrame) -> DataFrame:
        """(failed_pages): how many pages had no answer."""
        return self.replies(segments).agg(F.sum(F.col("failed").cast("int")).alias("failed_pages"))


class NerLayer(PageLayer):
    """A recogniser of entities asked once for each page, whose text is the segments joined by single spaces.

    load() gives the function from a text to entities: dicts with entity_group (or
    entity), score, start and end. An entity counts for each segment that it touches.
    A page whose call fails after the retries is marked; blank pages aren't asked about.
    """

    name = "ner"

    def __init__(self, load: Callable[[], Callable[[str], list]], available: bool = True, names: dict[str, str] = GROUPS, least: float = GROUP_SCORE, pause: float = PAUSE):
        self._load, self._available, self._names, self._least, self._pause = load, available, names, least, pause

    @property
    def available(self) -> bool:
        return self._available

    def pages(self, segments: DataFrame) -> DataFrame:
        load, names, least, pause = self._load, self._names, self._least, self._pause
        page = segments.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
        page = page.select("image_id", F.col("s.seg_idx").alias("numbers"), F.col("s.text").alias("texts"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = None
            for batch in batches:
                rows = []
                for image_id, numbers, texts in zip(batch["image_id"], batch["numbers"], batch["texts"], strict=True):
                    found, failed = {}, False
                    if any(t.strip() for t in texts):
                        try:
                            ask = ask or load()
                            entities = retried(ask, " ".join(texts), pause=pause)
                            found = segments_of(entities, list(numbers), list(texts), names, least)
                        except Exception:
                            failed = True
                    rows.append((image_id, [{"seg_idx": int(n), "categories": sorted(c)} for n, c in found.items()], failed))
                yield pd.DataFrame(rows, columns=["image_id", "found", "failed"])

        return page.mapInPandas(run, "image_id string, found array<struct<seg_idx:int,categories:array<string>>>, failed boolean")


def segments_of(entities, numbers: list[int], texts: list[str], names: dict[str, str], least: float) -> dict[int, set[str]]:
    """The categories of each segment (by its number) that a usable entity touches; entities that aren't usable are left out alone."""
    out: dict[int, set[str]] = {}
    for e in entities if isinstance(entities, list) else []:
        if not isinstance(e, dict):
            continue
        label, start, end = e.get("entity_group") or e.get("entity"), e.get("start"), e.get("end")
        try:
            score = float(e.get("score", 1.0))
        except (TypeError, ValueError):
            continue
        if not isinstance(label, str) or not isinstance(start, int) or not isinstance(end, int) or end <= start or score < least or label.upper() not in names:
            continue
        at = 0
        for number, text in zip(numbers, texts, strict=True):
            if at < end and start < at + len(text):
                out.setdefault(number, set()).add(names[label.upper()])
            at += len(text) + 1
    return out


class PandasLayer(RowLayer):
    """A model that looks at segments one by one; load() gives the function from a text to its categories.

    A segment whose call fails gives no categories and is marked; blank ones aren't asked about.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[str], set]], available: bool = True):
        self.name, self._load, self._available = name, load, available

    @property
    def available(self) -> bool:
        return self._available

    def outcome(self, text: Column) -> tuple[Column, Column]:
        load = self._load

        @F.pandas_udf("categories array<string>, failed boolean")
        def classified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = None
            for batch in batches:
                rows = []
                for t in batch:
                    try:
                        model = model or load()
                        rows.append((sorted(model(t)) if t and t.strip() else [], False))
                    except Exception:
                        rows.append(([], True))
                yield pd.DataFrame(rows, columns=["categories", "failed"])

        found = classified(text.cast("string"))
        return found["categories"], found["failed"]


class SegmentSource(ABC):
    """Text recognition: images to segments (image_id, seg_idx, text, box, confidence)."""

    @property
    def available(self) -> bool:
        return True

    @abstractmethod
    def segments(self, images: DataFrame) -> DataFrame:
        """The segments of images; an image that fails gives none."""


class ClientSource(SegmentSource):
    """A recognition service or local model asked once for each image.

    load() gives the function from (height, width, channels, data) to lines of (text,
    (x, y, width, height), confidence). An image whose call fails after the retries, or with a
    malformed line, gives no segments and a row in errors(): all lines or none.
    """

    def __init__(self, load: Callable[[], Callable[[int, int, int, bytes], list]], available: bool = True, pause: float = PAUSE):
        self._load, self._available, self._pause = load, available, pause

    @property
    def available(self) -> bool:
        return self._available

    def recognised(self, images: DataFrame) -> DataFrame:
        """(image_id, lines, message) for each of images (image_id, height, width, channels, data); write it where both parts are wanted."""
        load, pause = self._load, self._pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = None
            for batch in batches:
                rows = []
                for image_id, h, w, c, data in zip(*(batch[k] for k in ("image_id", "height", "width", "channels", "data")), strict=True):
                    try:
                        ask = ask or load()
                        lines = []
                        for text, (x, y, width, height), sure in retried(ask, int(h), int(w), int(c), data, pause=pause):
                            x, y = min(max(int(x), 0), int(w) - 1), min(max(int(y), 0), int(h) - 1)
                            box = {"x": x, "y": y, "width": min(max(int(width), 1), int(w) - x), "height": min(max(int(height), 1), int(h) - y)}
                            lines.append({"text": str(text), "box": box, "confidence": min(max(float(sure), 0.0), 1.0)})
                        rows.append((image_id, lines, None))
                    except Exception as error:
                        rows.append((image_id, None, str(error) or type(error).__name__))
                yield pd.DataFrame(rows, columns=["image_id", "lines", "message"])

        return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id string, lines array<struct<text:string,box:struct<x:int,y:int,width:int,height:int>,confidence:double>>, message string")

    def segments(self, images: DataFrame) -> DataFrame:
        return self.recognised(images).select("image_id", F.posexplode("lines").alias("seg_idx", "l")).select("image_id", "seg_idx", "l.text", "l.box", "l.confidence")

    def errors(self, images: DataFrame) -> DataFrame:
        """(image_id, code, message) of the images that gave none."""
        return self.recognised(images).filter("message IS NOT NULL").select("image_id", F.lit("OCR_FAILED").alias("code"), "message")
