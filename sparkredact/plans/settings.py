"""Settings of a session: which recognition results are read, and which layers take part."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Kinds of recognition results: a service's overlay (images are taken as they are) or polygons of a local model.
RECOGNITION = ("overlay", "polygons")


@dataclass(frozen=True)
class Settings:
    recognition: str = "overlay"
    use_layers: bool = True
    redact: bool = True

    @property
    def passthrough(self) -> bool:
        """Whether images are neither scaled nor turned: the service does that itself."""
        return self.recognition != "polygons"


def settings(spark: SparkSession) -> Settings:
    """From the environment (SPARKREDACT_RECOGNITION and so on), else the session (sparkredact.recognition), else as they are."""

    def of(name: str, default: str) -> str:
        return (os.environ.get(f"SPARKREDACT_{name.upper()}") or spark.conf.get(f"sparkredact.{name}", default)).strip().lower()

    kind = of("recognition", "overlay")
    if kind not in RECOGNITION:
        raise ValueError(f"recognition must be one of {', '.join(RECOGNITION)}, not {kind!r}")
    return Settings(kind, of("use_layers", "true") == "true", of("redact", "true") == "true")
