"""Sources, projections, taxonomy, counts, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.arrays import as_float
from labelkit.functions.text import coalesce_nonempty
from labelkit.operators import audio, metrics, ranking, sampling, synth, taxonomy
from labelkit.operators.bounded import local_table
from labelkit.plans.registry import query, table
from labelkit.plans.standins import (
    CATEGORY_SQL,
    MAPPED_SQL,
    PART_CATEGORIES,
    PART_DIM_SQL,
    PART_SKIP,
    PREDICTED_SQL,
    SEED,
    TRIPLES_SQL,
    categorised,
    checksum,
    checksum_sql,
    noise_sql,
    part_dim,
    predict_language,
    triples,
)
from labelkit.session import shared_dir
from labelkit.sinks.writers import class_metric_rows, write_files, write_label_arrays, write_label_json, write_metrics
from labelkit.sources.columns import tag_source
from labelkit.sources.datasets import load_status, read_many, read_split, select_split, union_all
from labelkit.sources import files
from labelkit.sources.files import LABEL_JSON_SCHEMA, drop_incomplete, read_examples_csv, uri_folder

LANGUAGES = ["en", "es", "it", "fr", "de", "pt"]
LABELLED_SQL = f"SELECT doc_id, {CATEGORY_SQL} AS category FROM labels"


# -- sources -----------------------------------------------------------------------------------


@query(
    r"""
SELECT folder, count(*) AS n_pages FROM (
  SELECT split_part(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1), '?', 1), '#', 1) AS folder
  FROM pages)
GROUP BY folder
"""
)
def scan_folder_label(spark: SparkSession, folder: str) -> DataFrame:
    """The folder part of a path as its label."""
    pages = table(spark, folder, "pages").select(uri_folder("url").alias("folder"))
    return pages.groupBy("folder").agg(F.count("*").alias("n_pages"))


@query(
    """
SELECT doc_id, source, lang, n_chars FROM documents
WHERE source = 'src1' AND lang = 'en' ORDER BY doc_id LIMIT 10
"""
)
def scan_split_slice(spark: SparkSession, folder: str) -> DataFrame:
    """First ten rows of one dataset and config."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    return select_split(docs, {"source": "src1", "lang": "en"}, limit=10, order="doc_id")


@query(
    """
SELECT name, CASE WHEN count(doc_id) > 0 THEN 'loaded' ELSE 'failed' END AS status, count(doc_id) AS n
FROM (VALUES ('en'), ('es'), ('it'), ('fr'), ('de'), ('pt')) AS wanted(name)
LEFT JOIN documents ON lang = name GROUP BY name
"""
)
def scan_many_status(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the wanted languages are there."""
    return load_status(table(spark, folder, "documents"), "lang", LANGUAGES)


@query("SELECT lang AS source_name, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'es', 'it', 'fr', 'de', 'pt') GROUP BY lang")
def read_many_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every wanted language as a source of its own, missing ones skipped, the rest in one table."""
    docs = table(spark, folder, "documents").select("lang", "n_chars")
    readers = {name: lambda name=name: docs.where(F.col("lang") == name) for name in LANGUAGES}
    rows, _ = read_many(spark, readers, ["n_chars"])
    return rows.groupBy("source_name").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """
WITH f AS (SELECT DISTINCT lang, source, doc_id // 8 AS part FROM documents)
SELECT lang AS folder, count(*) FILTER (WHERE part % 4 <> 3 AND part % 3 <> 2) AS n_flat,
       count(*) FILTER (WHERE part % 3 <> 2) AS n_tree
FROM f GROUP BY lang
"""
)
def scan_folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files per labelled folder, one level down and in the whole tree.

    The query writes the files: one for eight ids of a language and source, every fourth one level
    deeper, with three endings, one of which is not asked for.
    """
    root = shared_dir(spark, "labelled-files")
    part = F.floor(F.col("doc_id") / 8)
    ids = table(spark, folder, "documents").groupBy("lang", "source", part.alias("part")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("doc_id"))).alias("content")
    )
    ending = F.element_at(F.array(F.lit("png"), F.lit("JPG"), F.lit("txt")), (F.col("part") % 3 + 1).cast("int"))
    below = F.when(F.col("part") % 4 == 3, F.concat("source", F.lit("/"))).otherwise("")
    name = F.concat("lang", F.lit("/"), below, "source", F.lit("-"), "part", F.lit("."), ending)
    # rows are few bytes and a file each: dealt by number, or all of them would be one task's
    dealt = ids.withColumn("path", name).repartition(4 * spark.sparkContext.defaultParallelism, "path")
    write_files(dealt, root)
    flat = files.scan_folder(spark, root).withColumn("flat", F.lit(1))
    tree = files.scan_folder(spark, root, recursive=True).withColumn("flat", F.lit(0))
    return flat.unionByName(tree).groupBy("folder").agg(
        F.sum("flat").alias("n_flat"), F.count_if(F.col("flat") == 0).alias("n_tree")
    )


@query(
    f"""
SELECT vec_id, len(noise)::INTEGER AS n_samples, 'noise' AS language_str,
       {checksum_sql('list_transform(noise, lambda x: (x * 0.1::DOUBLE)::FLOAT)')} AS checksum
FROM (SELECT vec_id, noise FROM ({noise_sql("SELECT vec_id FROM embeddings", "vec_id", 64)}))
"""
)
def gen_noise(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded noise waveform for every embedding row: its size, label and checksum."""
    keys = table(spark, folder, "embeddings").select("vec_id")
    noise = audio.noise_rows(keys, "vec_id", 64, 0.1, SEED)
    return noise.select("vec_id", F.size("audio.array").alias("n_samples"), "language_str", checksum(F.col("audio.array")).alias("checksum"))


# -- projections and filters -------------------------------------------------------------------


@query("SELECT doc_id, 0 AS language, 'en' AS language_str, 'src' AS original_lang FROM documents")
def proj_tag(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return tag_source(docs, language=0, language_str="en", original_lang="src")


@query(
    """
WITH listed AS (SELECT * FROM (VALUES (0,'en'), (1,'es'), (2,'it'), (3,'fr'), (4,'de'), (5,'pt')) AS t(pos, label)),
counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
kept AS (SELECT pos, label FROM listed WHERE label IN (SELECT lang FROM counts)
         UNION ALL VALUES (6, 'noise'), (7, 'others'))
SELECT label, (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS class_id, coalesce(n, 0) AS n
FROM kept LEFT JOIN counts ON lang = label
"""
)
def dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Gap-free class ids of the languages that occur, then noise and others, with their rows."""
    docs = table(spark, folder, "documents").select("lang")
    ids = taxonomy.dense_ids(docs, "lang", LANGUAGES)
    known = taxonomy.assign_ids(docs, ids, "lang").groupBy("class_id").agg(F.count("*").alias("n"))
    return ids.join(known, "class_id", "left").select(
        "label", "class_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


@query("SELECT vec_id, CASE WHEN label < 8 THEN 'class_' || label END AS label_name FROM embeddings")
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Class names by id; ids 8 and up have none."""
    ids = local_table(
        spark, {"class_id": range(8), "label": [f"class_{i}" for i in range(8)]}, "class_id int, label string"
    )
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return taxonomy.with_label(rows, ids, "label").select("vec_id", "label_name")


@query(MAPPED_SQL)
def taxonomy_inner(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return taxonomy.map_taxonomy(parts, part_dim(spark), "p_type")


@query(
    f"SELECT p_partkey, p_type, coalesce(category, 'harm') AS category FROM part LEFT JOIN {PART_DIM_SQL} USING (p_type)"
)
def taxonomy_default(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return taxonomy.map_taxonomy(parts, part_dim(spark), "p_type", default="harm")


@query(
    f"SELECT DISTINCT p_type FROM part WHERE p_type <> 'LARGE' AND p_type NOT IN (SELECT p_type FROM {PART_DIM_SQL})"
)
def taxonomy_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.unmapped(table(spark, folder, "part"), part_dim(spark), "p_type", PART_SKIP)


@query(
    "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id "
    "WHERE d.source IS NOT NULL AND l.quality IS NOT NULL"
)
def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    return drop_incomplete(joined, ["source", "quality"])


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1 OFFSET 7")
def row_at(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.row_at(table(spark, folder, "benchmark"), "item_id", 7)


@query(
    """
SELECT 'd' || doc_id AS id, md5(CASE WHEN source = 'src1' THEN NULL WHEN lang = 'en' THEN text ELSE source END) AS found
FROM documents
UNION ALL SELECT 'b' || item_id, md5(text) FROM benchmark
"""
)
def coalesce_ref(spark: SparkSession, folder: str) -> DataFrame:
    """First non-empty reference field over rows that keep it under different names."""
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.when((F.col("lang") == "en") & (F.col("source") != "src1"), F.col("text")).otherwise("").alias("text"),
        F.when(F.col("source") != "src1", F.col("source")).alias("transcript"),
    )
    bench = table(spark, folder, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("sentence")
    )
    rows = union_all([docs, bench])
    return rows.select("id", F.md5(coalesce_nonempty("text", "transcript", "sentence")).alias("found"))


@query(
    f"SELECT vec_id, len(embedding)::INTEGER AS n, {checksum_sql('embedding')} AS checksum FROM embeddings"
)
def arr_cast(spark: SparkSession, folder: str) -> DataFrame:
    wave = as_float(F.col("embedding").cast("array<double>"))
    return table(spark, folder, "embeddings").select("vec_id", F.size(wave).alias("n"), checksum(wave).alias("checksum"))


# -- joins -------------------------------------------------------------------------------------


@query(
    f"""
WITH r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rn,
                  count(*) OVER (PARTITION BY category) AS n FROM ({LABELLED_SQL}))
SELECT doc_id, lang FROM documents
WHERE doc_id IN (SELECT doc_id FROM r WHERE rn <= floor(n * 0.8::DOUBLE))
"""
)
def split_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose id is in the train index."""
    train = sampling.stratified_split(categorised(spark, folder), "category", "doc_id", 0.8, SEED)
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.keep_split(docs, train.where(F.col("split") == "train"), "doc_id")


@query(f"SELECT doc_id, lang, pred, quality FROM ({PREDICTED_SQL}) JOIN labels USING (doc_id)")
def join_pred_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The rule runs on the documents that have a truth, after the join."""
    truth = table(spark, folder, "labels").select("doc_id", "quality")
    joined = metrics.join_predictions(truth, table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    return joined.select("doc_id", "lang", predict_language("text").alias("pred"), "quality")


# -- counts ------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.label_counts(table(spark, folder, "documents"), "lang")


@query(
    f"""
SELECT c.category, count(p_partkey) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D')) AS c(category)
LEFT JOIN ({MAPPED_SQL}) m ON m.category = c.category GROUP BY c.category
"""
)
def label_counts_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Category counts with the empty ones."""
    dim = local_table(spark, {"category": PART_CATEGORIES}, "category string")
    return taxonomy.label_counts(taxonomy_inner(spark, folder), "category", dim)


@query(
    f"""
WITH r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rn,
                  count(*) OVER (PARTITION BY category) AS n FROM ({LABELLED_SQL}))
SELECT category, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split, count(*) AS n
FROM r GROUP BY ALL
"""
)
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.split_sizes(split_stratified(spark, folder), ["category", "split"])


# -- orders and splits -------------------------------------------------------------------------


@query(
    f"""
SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rank
FROM ({LABELLED_SQL})
"""
)
def shuffle_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.group_rank(categorised(spark, folder), "doc_id", "category", SEED)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rank FROM documents")
def global_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.global_rank(table(spark, folder, "documents").select("doc_id"), "doc_id", SEED)


@query(
    f"""
WITH r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rn,
                  count(*) OVER (PARTITION BY category) AS n FROM ({LABELLED_SQL}))
SELECT doc_id, category, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r
"""
)
def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_split(categorised(spark, folder), "category", "doc_id", 0.8, SEED)


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r
"""
)
def split_random(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.random_split(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.2, SEED)


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents),
h AS (SELECT *, ceil(n * 0.2::DOUBLE) AS held FROM r)
SELECT doc_id, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - ceil(held * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM h
"""
)
def split_three_way(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.three_way_split(table(spark, folder, "documents").select("doc_id"), "doc_id", seed=SEED)


@query(
    """
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS rn, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r
"""
)
def split_floor(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id")
    return sampling.random_split(rows, "vec_id", 0.2, SEED, "floor_train", ("train", "val"))


@query(
    """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 100
"""
)
def cap_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.cap_per_group(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query(
    f"""
WITH r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id), doc_id) AS rn,
                  count(*) OVER (PARTITION BY category) AS n FROM ({LABELLED_SQL}))
SELECT doc_id, category FROM r WHERE rn <= 5 AND rn <= floor(n * 0.8::DOUBLE)
"""
)
def sample_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """Five rows of each category of the train part."""
    train = split_stratified(spark, folder).where(F.col("split") == "train")
    return sampling.sample_per_group(train, "category", "doc_id", 5, SEED).select("doc_id", "category")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def head_n(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.head_n(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), "doc_id", 50)


@query(
    "SELECT 'documents' AS origin, doc_id AS id, length(text)::INTEGER AS n_chars FROM documents "
    "UNION ALL SELECT 'benchmark', item_id, length(text)::INTEGER FROM benchmark"
)
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n_chars"))
    bench = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n_chars"))
    return union_all([tag_source(docs, origin="documents"), tag_source(bench, origin="benchmark")])


# -- multi-label synthesis ---------------------------------------------------------------------


def _synth_sql(pool: str, name: str) -> str:
    """Common table expressions that make the multi-label rows of ``pool`` (p_partkey, category)."""
    return f"""
{name}_sizes AS (SELECT category, count(*) AS size FROM {pool} GROUP BY category),
{name}_rows AS (SELECT unnest(range(floor((SELECT count(*) FROM {pool}) * 0.2::DOUBLE / (1 - 0.2::DOUBLE))::BIGINT)) AS id),
{name}_drawn AS (
  SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY md5('42|pick|' || id || '|' || c), c) AS pos,
         2 + ('0x' || substr(md5('42|size|' || id), 1, 8))::BIGINT % 2 AS wanted
  FROM {name}_rows, (VALUES ('A'), ('B'), ('C'), ('D')) AS cats(c)),
{name}_labels AS (SELECT id, string_agg(c, ', ' ORDER BY pos) AS labels FROM {name}_drawn WHERE pos <= wanted GROUP BY id),
{name}_first AS (
  SELECT id, arg_min(c, pos) AS category FROM {name}_drawn JOIN {name}_sizes s ON s.category = c WHERE pos <= wanted GROUP BY id),
{name}_ranked AS (SELECT p_partkey, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || p_partkey), p_partkey) AS rn FROM {pool}),
{name}_made AS (
  SELECT f.id AS row, r.p_partkey, l.labels FROM {name}_first f JOIN {name}_sizes s USING (category)
  JOIN {name}_labels l USING (id)
  JOIN {name}_ranked r ON r.category = f.category
   AND r.rn = ('0x' || substr(md5('42|item|' || f.id), 1, 8))::BIGINT % s.size + 1)
"""


@query(f"WITH pool AS ({MAPPED_SQL}), {_synth_sql('pool', 'x')} SELECT row, p_partkey, labels FROM x_made")
def synth_multilabel(spark: SparkSession, folder: str) -> DataFrame:
    pool = taxonomy_inner(spark, folder)
    return synth.synth_multilabel(pool, "p_partkey", PART_CATEGORIES, 0.2, SEED)


@query(
    f"""
WITH cut AS (SELECT p_partkey, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || p_partkey), p_partkey) AS rn,
                    count(*) OVER (PARTITION BY category) AS n FROM ({MAPPED_SQL})),
train AS (SELECT * FROM cut WHERE rn <= floor(n * 0.8::DOUBLE)),
val AS (SELECT * FROM cut WHERE rn > floor(n * 0.8::DOUBLE)),
sample AS (SELECT * FROM train WHERE rn <= 5),
{_synth_sql('train', 't')}, {_synth_sql('val', 'v')}, {_synth_sql('sample', 's')},
built AS (
  SELECT 'train' AS split, p_partkey, category AS labels, false AS is_multi, -1 AS row FROM train
  UNION ALL SELECT 'val', p_partkey, category, false, -1 FROM val
  UNION ALL SELECT 'sample', p_partkey, category, false, -1 FROM sample
  UNION ALL SELECT 'train', p_partkey, labels, true, row FROM t_made
  UNION ALL SELECT 'val', p_partkey, labels, true, row FROM v_made
  UNION ALL SELECT 'sample', p_partkey, labels, true, row FROM s_made)
SELECT split, p_partkey, labels, is_multi, md5('42|' || split || '|' || p_partkey || '|' || row) AS shuffle FROM built
"""
)
def build_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Train, val and sample parts with their multi-label rows."""
    return synth.build_dataset(taxonomy_inner(spark, folder), "p_partkey", PART_CATEGORIES, 0.8, 0.2, seed=SEED)


# -- files written and read back ---------------------------------------------------------------


@query(f"SELECT md5(system) AS prompt, md5(question) AS question, md5(response) AS response FROM ({TRIPLES_SQL})")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction triples as CSV with newlines and quotes inside, read by column name."""
    path = shared_dir(spark, "csv")
    rows = triples(spark, folder).select(F.col("system").alias("prompt"), "question", "response")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = read_examples_csv(spark, path)
    return back.select(*[F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in back.columns])


@query(
    f"""
WITH r AS (SELECT p_partkey, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || p_partkey), p_partkey) AS rn,
                  count(*) OVER (PARTITION BY category) AS n FROM ({MAPPED_SQL}))
SELECT 'img/' || p_partkey || '.png' AS image_path, category || ', ' || 'Part' AS labels,
       CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r
"""
)
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled dataset as JSON per split, read back."""
    path = shared_dir(spark, "json")
    rows = sampling.stratified_split(taxonomy_inner(spark, folder), "category", "p_partkey", 0.8, SEED).select(
        F.concat(F.lit("img/"), "p_partkey", F.lit(".png")).alias("image_path"),
        F.array("category", F.lit("Part")).alias("labels"),
        "split",
    )
    write_label_json(rows, path)
    return spark.read.schema(LABEL_JSON_SCHEMA + ", split string").json(path)


@query("SELECT 'img/' || doc_id || '.png' AS image_path, md5(d.text) AS labels, lang, item_id FROM documents d LEFT JOIN benchmark ON item_id = doc_id")
def json_array_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as labels in files that hold one JSON array each, on one line or on many, read in splits."""
    path = shared_dir(spark, "json-array")
    docs = table(spark, folder, "documents").join(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id"), "doc_id", "left")
    labelled = docs.select(
        F.concat(F.lit("img/"), "doc_id", F.lit(".png")).alias("image_path"), F.col("text").alias("labels"), F.struct("lang", F.array("item_id").alias("items")).alias("about")
    )
    write_label_arrays(labelled, path)
    schema = "image_path string, labels string, about struct<lang: string, items: array<bigint>>"
    back = files.read_label_json(spark, path, schema)
    return back.select("image_path", F.md5("labels").alias("labels"), "about.lang", F.get("about.items", F.lit(0)).alias("item_id"))


@query("SELECT doc_id AS id, n_chars FROM documents WHERE source = 'src2' AND lang = 'fr' AND n_chars > 500 ORDER BY doc_id LIMIT 10")
def read_split_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Slice of one dataset, config and split of a partitioned table; other partitions are not read."""
    path = shared_dir(spark, "splits")
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "n_chars",
        F.col("source").alias("dataset"),
        F.col("lang").alias("config"),
        F.when(F.col("n_chars") > 500, "long").otherwise("short").alias("split"),
    )
    # a large part is spread over several writers
    docs.repartition("dataset", "config", "split", F.col("id") % 16).write.partitionBy("dataset", "config", "split").parquet(path)
    return read_split(spark, path, "src2", "long[:10]", "fr", "id").select("id", "n_chars")


@query(
    """
SELECT 'per_type' AS scope, event_type AS name, 'mean_value' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type
UNION ALL SELECT 'per_type', event_type, 'n', count(*)::DOUBLE FROM events GROUP BY event_type
"""
)
def metric_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Per-class metrics as long rows in a metric table."""
    path = shared_dir(spark, "metrics")
    per_type = table(spark, folder, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n")
    )
    write_metrics(class_metric_rows(per_type, ["mean_value", "n"], "per_type", "event_type"), path)
    return spark.read.parquet(path)
