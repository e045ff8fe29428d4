"""Images: decoded rows to PNG bytes.

Spark's image source decodes PNG, JPEG, GIF and BMP.  PNG is encoded here with zlib; encoders for
JPEG and WEBP are not among the permitted libraries, so these targets are refused with a reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of an array [height, width, channels] with 1 (grey), 3 (RGB) or 4 (RGBA) channels."""
    height, width, channels = pixels.shape
    colour = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)])
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels in RGB order from Spark's BGR rows."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels if channels == 1 else pixels[:, :, [2, 1, 0, *range(3, channels)]]


def convert(images: DataFrame, target: str = "png") -> DataFrame:
    """origin, data, error for image rows; those that could not be decoded keep the scan's error."""
    why = None if target == "png" else f"{target.upper()} output needs an encoder that is not installed."

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            errors = [r["error"] or why for r in rows]
            data = [None if e else encode_png(from_bgr(r["data"], r["height"], r["width"], r["nChannels"])) for r, e in zip(rows, errors)]
            yield pa.RecordBatch.from_arrays([pa.array([r["origin"] for r in rows], pa.string()), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["origin", "data", "error"])

    error = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    return images.select("origin", "height", "width", "nChannels", "data", error.alias("error")).mapInArrow(run, "origin string, data binary, error string")
