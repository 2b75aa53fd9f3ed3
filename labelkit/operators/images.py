"""Image rows: validity, corpus profile and model-ready pixel arrays."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Per-channel mean and deviation (red, green, blue) the image models expect.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Fixed values of the file formats: first bytes of a PNG file, chunks of a webp file that hold pixels.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
WEBP_PIXELS = (b"VP8 ", b"VP8L", b"ANMF")


@F.pandas_udf(T.BooleanType())
def is_webp(content: pd.Series) -> pd.Series:
    """RIFF container of kind WEBP whose chunks end where the container ends, one of them with pixels.

    Only chunk headers are looked at; null is no image.
    """

    def whole(body: bytes | None) -> bool:
        if body is None or body[:4] != b"RIFF" or body[8:12] != b"WEBP":
            return False
        end = 8 + int.from_bytes(body[4:8], "little")
        if end > len(body):
            return False
        at, pixels = 12, False
        while at + 8 <= end:
            size = int.from_bytes(body[at + 4:at + 8], "little")
            if at + 8 + size > end:
                return False
            pixels = pixels or body[at:at + 4] in WEBP_PIXELS
            at += 8 + size + size % 2
        return pixels and at in (end, end + 1)

    return content.map(whole).astype("bool")


@F.pandas_udf(T.BinaryType())
def encode_png(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
    """PNG file of 8-bit red, green, blue values in row order; null where a value is missing or the
    number of values is not 3 * width * height."""
    import numpy as np

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def encode(w: int, h: int, values) -> bytes | None:
        if values is None or pd.isna(w) or pd.isna(h) or len(values) != 3 * w * h:
            return None
        lines = np.zeros((int(h), 1 + 3 * int(w)), dtype="uint8")  # each line starts with its filter, none
        lines[:, 1:] = np.asarray(values).reshape(int(h), -1)
        head = struct.pack(">IIBBBBB", int(w), int(h), 8, 2, 0, 0, 0)
        return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")

    return pd.Series([encode(*row) for row in zip(width, height, pixels)], dtype="object")


def valid_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` that decode as an image.

    The image source drops what the JVM cannot decode.  Of webp files, which it does not know, the
    chunks are checked; no other file is read for that.
    """
    decoded = (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
        .select(F.col("image.origin").alias("path"))
    )
    webp = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][eE][bB][pP]")
        .load(root).where(is_webp("content")).select("path")
    )
    return decoded.unionByName(webp)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: path and the ``image`` struct."""
    return (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
        .select(F.col("image.origin").alias("path"), "image")
    )


def image_profile(images: DataFrame, by: str) -> DataFrame:
    """Per category: images, size range and channel counts."""
    return images.groupBy(by).agg(
        F.count("*").alias("n"),
        F.min("image.width").alias("min_width"),
        F.max("image.width").alias("max_width"),
        F.min("image.height").alias("min_height"),
        F.max("image.height").alias("max_height"),
        F.array_sort(F.collect_set("image.nChannels")).alias("channels"),
    )


def image_features(images: DataFrame, size: int = 224) -> DataFrame:
    """(path, features): centre square of ``size`` pixels, scaled and normalised, channel first.

    Pixels come from the image source as blue, green, red bytes.  An image smaller than the square
    is padded with black around its centre.  Resizing is left to the image library in use.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        mean = np.asarray(CHANNEL_MEAN, dtype="float32")[:, None, None]
        std = np.asarray(CHANNEL_STD, dtype="float32")[:, None, None]

        def one(height: int, width: int, channels: int, data: bytes) -> "np.ndarray":
            pixels = np.frombuffer(data, dtype="uint8").reshape(height, width, channels)
            rgb = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
            square = np.zeros((size, size, 3), dtype="float32")
            top, left = (height - size) // 2, (width - size) // 2
            src = rgb[max(top, 0): max(top, 0) + size, max(left, 0): max(left, 0) + size]
            y, x = max(-top, 0), max(-left, 0)
            square[y: y + src.shape[0], x: x + src.shape[1]] = src
            return ((square.transpose(2, 0, 1) / 255.0 - mean) / std).ravel()

        for batch in batches:
            rows = zip(batch["height"], batch["width"], batch["nChannels"], batch["data"])
            yield pd.DataFrame({"path": batch["path"], "features": [one(*r) for r in rows]})

    flat = images.select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(task, "path string, features array<float>")
