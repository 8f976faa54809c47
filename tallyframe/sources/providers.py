"""Recognisers behind one interface: a function from batches of images to batches of lines.

Models and images are no part of this engine. A provider is any function that
mapInArrow takes; a failure of one image becomes a row with ok = false and an error,
so one bad image never fails a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "image_id string, ok boolean, provider string, text string, confidence double, x1 int, y1 int, x2 int, y2 int, error string"
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def recognise(images: DataFrame, name: str, read: Callable[[bytes], list[dict]]) -> DataFrame:
    """images(image_id, content) -> one row per line (SCHEMA); read gives an image's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {"image_id": image, "ok": True, "provider": name}
                try:
                    rows += [seen | line for line in read(content or b"")] or [seen]
                except Exception as e:  # the row carries it
                    rows.append(seen | {"ok": False, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return images.select("image_id", "content").mapInArrow(run, SCHEMA)


def blank(_: bytes) -> list[dict]:
    """The provider of tests: every image is a page without text."""
    return []
