"""Stages that need models or pixels, behind one contract: a function on pandas frames with a schema, run by mapInPandas.

None is shipped with weights. Unknown names raise; a stage is built once a worker, from its factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Stage = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass
class Registry:
    """Named factories of one kind of stage: decode, rectify, detect, recognise or correct."""

    kind: str
    schema: str
    factories: dict[str, Callable[[], Stage]] = field(default_factory=dict)

    def register(self, name: str, factory: Callable[[], Stage]) -> None:
        self.factories[name.lower()] = factory

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """Run a stage over df. Rows that fail don't end the job: the stage reports them in its own `error` column."""
        if name.lower() not in self.factories:
            raise ValueError(f"unknown {self.kind}: {name}; there are {sorted(self.factories)}")
        factory = self.factories[name.lower()]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            stage = factory()
            for f in frames:
                yield stage(f)

        return df.mapInPandas(run, self.schema)


DECODERS = Registry("decoder", "path string, page_number int, width int, height int, content binary, error string")
RECTIFIERS = Registry("rectifier", "path string, page_number int, content binary, backend string, applied boolean, confidence double, error string")
DETECTORS = Registry("detector", "path string, page_number int, idx int, points array<struct<x:float,y:float>>, confidence double, source string, error string")
RECOGNISERS = Registry("recogniser", "path string, page_number int, idx int, pos int, text string, acoustic_logprob double, error string")
CORRECTORS = Registry("corrector", "path string, page_number int, idx int, name string, text string, error string")
