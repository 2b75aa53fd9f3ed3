"""Image files made from the rows of a table, read back, checked, profiled and turned into features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.operators import images
from labelkit.plans.registry import query, table
from labelkit.session import shared_dir
from labelkit.sinks.writers import write_files
from labelkit.sources.files import path_below

# 64 values of a row are the red channel of an image of 8 x 8 or 16 x 4 pixels; green is red from the
# end, blue is the class.
IMAGE_SQL = """
SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 16 ELSE 8 END AS w, CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 8 END AS h,
       list_transform(embedding::DOUBLE[], lambda x: floor(greatest(least(x * 127.5::DOUBLE + 127.5::DOUBLE, 255), 0))::BIGINT) AS red
FROM embeddings
"""


def _red() -> Column:
    half = F.lit(127.5)
    return F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.floor(F.greatest(F.least(x * half + half, F.lit(255.0)), F.lit(0.0))).cast("int"),
    )


def _pixels() -> Column:
    blue = F.col("label").cast("int")
    return F.flatten(F.zip_with("red", F.reverse("red"), lambda r, g: F.array(r, g, blue)))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    wide = F.col("vec_id") % 3 == 0
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.when(wide, 16).otherwise(8).alias("w"),
        F.when(wide, 4).otherwise(8).alias("h"),
        _red().alias("red"),
    )


def _name(ending: str) -> Column:
    return F.format_string("class_%d/%d." + ending, F.col("label"), F.col("vec_id"))


def _written(spark: SparkSession, folder: str) -> str:
    """Every row as a PNG file in the folder of its class."""
    root = shared_dir(spark, "images")
    png = images.encode_png("w", "h", _pixels())
    write_files(_rows(spark, folder).select(_name("png").alias("path"), png.alias("content")), root)
    return root


def _little(n: Column) -> Column:
    """Four bytes, smallest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)])


def _riff(size_error: Column, kind: str) -> Column:
    """A webp container with one chunk of the row's red values."""
    data = F.unhex(F.array_join(F.transform("red", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))
    chunk = F.concat(F.encode(F.lit(kind), "UTF-8"), _little(F.size("red") + size_error), data)
    body = F.concat(F.encode(F.lit("WEBP"), "UTF-8"), chunk)
    return F.concat(F.encode(F.lit("RIFF"), "UTF-8"), _little(F.length(body)), body)


@query(
    """
SELECT 'class_' || label AS folder, count(*) AS n,
       count(*) FILTER (WHERE vec_id % 10 = 6) AS n_webp
FROM embeddings WHERE vec_id % 10 NOT IN (2, 3, 7, 8) GROUP BY label
"""
)
def valid_images(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are images, per folder: PNG and webp, among cut files, texts and broken containers."""
    root = shared_dir(spark, "mixed-files")
    png = images.encode_png("w", "h", _pixels())
    zero = F.lit(0)
    kinds = {
        2: ("png", F.substring(png, 1, 20)),  # cut within its header
        3: ("jpg", F.encode(F.col("vec_id").cast("string"), "UTF-8")),
        6: ("webp", _riff(zero, "VP8L")),
        7: ("WEBP", _riff(F.lit(1000), "VP8 ")),  # a chunk beyond the end
        8: ("webp", _riff(zero, "EXIF")),  # no pixels
    }
    rows = _rows(spark, folder)
    rest = rows.where(~(F.col("vec_id") % 10).isin(*kinds)).select(_name("png").alias("path"), png.alias("content"))
    for last, (ending, content) in kinds.items():
        rest = rest.unionByName(rows.where(F.col("vec_id") % 10 == last).select(_name(ending).alias("path"), content.alias("content")))
    write_files(rest, root)
    found = images.valid_images(spark, root)
    return found.groupBy(F.get(F.split(path_below("path", root), "/"), F.lit(0)).alias("folder")).agg(
        F.count("*").alias("n"), F.count_if(F.endswith(F.lower("path"), F.lit(".webp"))).alias("n_webp")
    )


@query(
    f"""
SELECT 'class_' || label AS folder, count(*) AS n, min(w) AS min_width, max(w) AS max_width, min(h) AS min_height,
       max(h) AS max_height, '3' AS channels
FROM ({IMAGE_SQL}) GROUP BY label
"""
)
def image_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and channels of the images of each class folder."""
    root = _written(spark, folder)
    read = images.read_images(spark, root)
    labelled = read.withColumn("folder", F.get(F.split(path_below("path", root), "/"), F.lit(0)))
    return images.image_profile(labelled, "folder").withColumn(
        "channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ",")
    )


SQUARE = 6
SUMS_SQL = ", ".join(
    f"list_sum(list_transform(range({SQUARE * SQUARE}), lambda k: (k + 1) * {value}))::BIGINT AS {name}"
    for name, value in {
        "red": "coalesce(red[spot[k + 1]], 0)",
        "green": "coalesce(red[65 - spot[k + 1]], 0)",
        "blue": "CASE WHEN spot[k + 1] IS NULL THEN 0 ELSE label END",
    }.items()
)


@query(
    f"""
WITH m AS ({IMAGE_SQL}),
p AS (SELECT *, list_transform(range({SQUARE * SQUARE}), lambda k:
          CASE WHEN k // {SQUARE} + (h - {SQUARE}) // 2 BETWEEN 0 AND h - 1
               THEN (k // {SQUARE} + (h - {SQUARE}) // 2) * w + (w - {SQUARE}) // 2 + k % {SQUARE} + 1 END) AS spot FROM m)
SELECT vec_id, {3 * SQUARE * SQUARE} AS n, {SUMS_SQL} FROM p
"""
)
def image_features(spark: SparkSession, folder: str) -> DataFrame:
    """Centre squares as model input; per channel the sum of pixel times place, taken back from the scaled values."""
    root = _written(spark, folder)
    made = images.image_features(images.read_images(spark, root), SQUARE)
    area = SQUARE * SQUARE

    def total(channel: int) -> Column:
        part = F.slice("features", channel * area + 1, area)
        mean, std = F.lit(images.CHANNEL_MEAN[channel]), F.lit(images.CHANNEL_STD[channel])
        pixels = F.transform(part, lambda x, i: F.round((x.cast("double") * std + mean) * 255).cast("bigint") * (i + 1))
        return F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return made.select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"),
        F.size("features").alias("n"),
        total(0).alias("red"),
        total(1).alias("green"),
        total(2).alias("blue"),
    )
