"""Label lists, templates, prompts and instruction-tuning rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions import chat, text
from labelkit.operators import search, sft
from labelkit.plans.registry import query, table
from labelkit.plans.standins import (
    CATEGORIES,
    CATEGORY_SQL,
    RESPONSE_SQL,
    TRIPLES_SQL,
    category,
    response,
    triples,
)

STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LIST_SQL = r"\[([\d,\s]+)\]@"


def strip_sql(value: str) -> str:
    return STRIP_SQL.format(value)


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic", response().alias("response"))


# -- label lists -------------------------------------------------------------------------------


@query(
    rf"""
SELECT doc_id, CASE
  WHEN regexp_matches(response, '{LIST_SQL}') THEN array_to_string(list_transform(
       string_split(regexp_extract(response, '{LIST_SQL}', 1), ','), lambda x: {strip_sql('x')}), '|')
  WHEN contains(lower(response), 'safe') THEN 'safe' ELSE '' END AS parsed
FROM ({RESPONSE_SQL})
"""
)
def parse_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _responses(spark, folder)
    return rows.select("doc_id", F.array_join(text.parse_labels("response"), "|").alias("parsed"))


@query(
    rf"""
WITH raw AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '@' WHEN turn % 3 = 1 THEN ' ' || text || ' @' || chr(10)
             ELSE text END AS t FROM conversations),
cut AS (SELECT conv_id, turn, CASE WHEN ends_with(t, '@') THEN left(t, length(t) - 1) ELSE t END AS t FROM raw)
SELECT conv_id, turn, length({strip_sql('t')})::INTEGER AS n_chars, md5({strip_sql('t')}) AS stripped FROM cut
"""
)
def strip_stop(spark: SparkSession, folder: str) -> DataFrame:
    """A trailing stop mark is cut, one followed by white space is not."""
    raw = (
        F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("@")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), "text", F.lit(" @\n")))
        .otherwise(F.col("text"))
    )
    cut = text.strip_stop(raw)
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.length(cut).alias("n_chars"), F.md5(cut).alias("stripped")
    )


@query(
    f"""
WITH r AS ({RESPONSE_SQL}),
p AS (SELECT doc_id, quality, toxic, quality::VARCHAR AS expected,
             regexp_matches(response, '{LIST_SQL}') AS parsed,
             contains(response, 'confidence') AND contains(response, '%') AS fmt FROM r),
m AS (SELECT *, CASE WHEN parsed THEN 1.0 ELSE 0.0 END::DOUBLE AS ok,
             1::DOUBLE / len(list_distinct([quality, toxic])) AS prec FROM p)
SELECT doc_id, CASE WHEN parsed AND fmt
       THEN round(0.6::DOUBLE * 1 + 0.4::DOUBLE * (2 * prec * 1 / (prec + 1)), 6) ELSE 0::DOUBLE END AS score
FROM m
"""
)
def label_score(spark: SparkSession, folder: str) -> DataFrame:
    """Combined format and label score; the expected list is the quality label."""
    expected = F.array(F.col("quality").cast("string"))
    rows = _responses(spark, folder)
    return rows.select("doc_id", F.round(text.label_score("response", expected), 6).alias("score"))


@query(
    rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(
         string_split(' ' || quality || ' ,' || toxic || ', ,' || {CATEGORY_SQL}, ','), lambda x: {strip_sql('x')}),
         lambda x: x <> ''), '|') AS parts
FROM labels
"""
)
def split_labels(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.concat(F.lit(" "), "quality", F.lit(" ,"), "toxic", F.lit(", ,"), category())
    return table(spark, folder, "labels").select(
        "doc_id", F.array_join(text.split_labels(joined), "|").alias("parts")
    )


WORD_CATEGORIES = ["copyright", "und das", "les des", "erthand"]


@query(
    rf"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {' OR '.join(f"contains(x, '{c}')" for c in WORD_CATEGORIES)}) AS hits
           FROM documents),
s AS (SELECT doc_id, {strip_sql('hits[1]')} AS line FROM l)
SELECT doc_id, md5(coalesce(nullif(line, ''), 'Safe Content')) AS line FROM s
"""
)
def parse_category_line(spark: SparkSession, folder: str) -> DataFrame:
    """First line that names one of a few phrases."""
    line = text.parse_category_line("text", WORD_CATEGORIES)
    return table(spark, folder, "documents").select("doc_id", F.md5(line).alias("line"))


@query(
    f"""
SELECT doc_id, c.category, CASE WHEN c.category = l.category THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
FROM (SELECT doc_id, {CATEGORY_SQL} AS category FROM labels) l, (VALUES ('toxic'), ('junk'), ('safe')) AS c(category)
"""
)
def onehot_conf(spark: SparkSession, folder: str) -> DataFrame:
    conf = text.onehot_conf(F.array(category()), CATEGORIES)
    return table(spark, folder, "labels").select("doc_id", F.explode(conf).alias("category", "confidence"))


# -- prompts -----------------------------------------------------------------------------------


@query(
    f"""
SELECT string_agg('- "' || text || '" → ' || category, chr(10) ORDER BY doc_id) AS examples
FROM (SELECT doc_id, text, {CATEGORY_SQL} AS category FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 10)
"""
)
def fewshot_text(spark: SparkSession, folder: str) -> DataFrame:
    """Ten labelled examples as prompt lines."""
    labels = table(spark, folder, "labels").select("doc_id", category().alias("category"))
    docs = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id")
    return search.render_fewshot(docs, "text", "category", "doc_id", 10)


@query(
    rf"""
WITH a AS (SELECT doc_id, replace(text, 'Th', 'Prompt:Th') AS t FROM documents),
h AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'Prompt') AND contains(x, ':')) AS hits FROM a),
p AS (SELECT doc_id, CASE WHEN len(hits) > 0
        THEN list_transform(hits, lambda x: {strip_sql("substr(x, instr(x, ':') + 1)")})
        ELSE string_split({strip_sql('t')}, chr(10) || chr(10)) END AS prompts FROM h),
u AS (SELECT doc_id, unnest(prompts) AS prompt, generate_subscripts(prompts, 1) - 1 AS pos FROM p)
SELECT doc_id, pos::INTEGER AS pos, md5(prompt) AS prompt FROM u
"""
)
def explode_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of stored answers; lines that start with "Th" play the numbered prompts."""
    answer = F.replace(F.col("text"), F.lit("Th"), F.lit("Prompt:Th"))
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(text.split_prompts(answer)).alias("pos", "prompt")).select(
        "doc_id", "pos", F.md5("prompt").alias("prompt")
    )


@query(
    r"""
WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN chr(10) || replace(text, ' ', chr(9) || ' ')
                                     ELSE regexp_replace(text, '[0-9]', '', 'g') END AS other FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS gold,
             trim(regexp_replace(lower(other), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS pred FROM t)
SELECT doc_id, CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS matched FROM s
"""
)
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Texts against themselves with other white space, or without their digits."""
    spaced = F.concat(F.lit("\n"), F.replace("text", F.lit(" "), F.lit("\t ")))
    other = F.when(F.col("doc_id") % 2 == 0, spaced).otherwise(F.regexp_replace("text", "[0-9]", ""))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.exact_match(other, "text").alias("matched"))


@query(
    f"""
SELECT {CATEGORY_SQL} AS category, round(avg(CASE WHEN 1 - toxic = quality THEN 1 ELSE -1 END), 6) AS reward, count(*) AS n
FROM labels GROUP BY 1
"""
)
def reward_avg(spark: SparkSession, folder: str) -> DataFrame:
    """Mean reward when a clean document is taken for a good one."""
    labels = table(spark, folder, "labels").withColumn("pred", 1 - F.col("toxic"))
    return labels.groupBy(category().alias("category")).agg(
        F.round(F.avg(text.reward("pred", "quality")), 6).alias("reward"), F.count("*").alias("n")
    )


# -- chat and tokens ---------------------------------------------------------------------------

NL = "chr(10)"
OPEN_CHAT_SQL = (
    f"'<|im_start|>system<|im_sep|>' || {NL} || system || '<|im_end|>' || {NL} || '<|im_start|>user<|im_sep|>' || {NL} "
    f"|| question || '<|im_end|>' || {NL} || '<|im_start|>assistant<|im_sep|>' || {NL}"
)
CLOSED_CHAT_SQL = (
    f"'<|im_start|>system' || {NL} || system || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || question "
    f"|| '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || response || '<|im_end|>' || {NL}"
)
TOKENS_SQL = r"regexp_extract_all({0}, '<\|[a-z_]+\|>|[\p{{L}}\p{{N}}_]+')"
ID_SQL = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 50000)"


@query(f"SELECT conv_id, turn, md5(system) AS system, md5(question) AS question, md5(response) AS response FROM ({TRIPLES_SQL})")
def sft_triples(spark: SparkSession, folder: str) -> DataFrame:
    parts = ["system", "question", "response"]
    return triples(spark, folder).select("conv_id", "turn", *[F.md5(p).alias(p) for p in parts])


@query(f"SELECT conv_id, turn, length({OPEN_CHAT_SQL})::INTEGER AS n_chars, md5({OPEN_CHAT_SQL}) AS chat FROM ({TRIPLES_SQL})")
def chat_open(spark: SparkSession, folder: str) -> DataFrame:
    rendered = chat.render_chat("system", "question", style="sep")
    return triples(spark, folder).select(
        "conv_id", "turn", F.length(rendered).alias("n_chars"), F.md5(rendered).alias("chat")
    )


@query(
    f"SELECT conv_id, turn, length({CLOSED_CHAT_SQL})::INTEGER AS n_chars, md5({CLOSED_CHAT_SQL}) AS chat FROM ({TRIPLES_SQL})"
)
def chat_closed(spark: SparkSession, folder: str) -> DataFrame:
    rendered = chat.render_chat("system", "question", "response")
    return triples(spark, folder).select(
        "conv_id", "turn", F.length(rendered).alias("n_chars"), F.md5(rendered).alias("chat")
    )


@query(f"SELECT conv_id, turn, len({TOKENS_SQL.format('text')})::INTEGER AS n_tokens FROM conversations")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", chat.token_count("text").alias("n_tokens"))


@query(
    f"""
WITH t AS (SELECT conv_id, turn, list_transform({TOKENS_SQL.format('text')}, lambda w: {ID_SQL.format('w')}) AS ids FROM conversations),
p AS (SELECT conv_id, turn, len(ids) AS n, list_resize(ids[1:32], 32, 0) AS padded FROM t)
SELECT conv_id, turn, len(padded)::INTEGER AS n_ids, list_sum(list_transform(padded, lambda x, i: x * i))::BIGINT AS id_sum,
       least(n, 32)::BIGINT AS mask_sum FROM p
"""
)
def pad_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Ids cut or padded to 32 places, with their attention mask."""
    ids = chat.token_ids(chat.tokenize("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", ids.alias("ids"))
    padded = rows.select(
        "conv_id",
        "turn",
        chat.pad_to(F.col("ids"), 32).alias("padded"),
        chat.attention_mask(F.size("ids"), 32).alias("mask"),
    )
    zero = F.lit(0).cast("bigint")
    return padded.select(
        "conv_id",
        "turn",
        F.size("padded").alias("n_ids"),
        F.aggregate(F.transform("padded", lambda x, i: x.cast("bigint") * (i + 1)), zero, lambda a, x: a + x).alias("id_sum"),
        F.aggregate("mask", zero, lambda a, x: a + x).alias("mask_sum"),
    )


PREFIX_SQL = (
    f"'<|im_start|>system' || {NL} || system || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || question || '<|im_end|>' || {NL}"
)


@query(
    f"""
WITH t AS (SELECT conv_id, turn, len({TOKENS_SQL.format(f'({PREFIX_SQL})')}) AS prefix, {TOKENS_SQL.format('response')} AS answer FROM ({TRIPLES_SQL})),
k AS (SELECT conv_id, turn, prefix + 2 AS start, answer, answer[1:greatest(128 - prefix - 2, 0)] AS kept FROM t)
SELECT conv_id, turn, len(kept)::BIGINT AS n_trained,
       coalesce(list_sum(list_transform(kept, lambda w, i: {ID_SQL.format('w')} * (start + i))), 0)::BIGINT AS id_sum
FROM k WHERE start < 128 AND len(answer) > 0
"""
)
def loss_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Trained tokens of sequences of 128: how many, and their ids times their places."""
    rows = sft.sft_rows(triples(spark, folder), 128).where("trainable")
    trained = F.transform("labels", lambda x, i: F.when(x != chat.IGNORED, x.cast("bigint") * (i + 1)))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "conv_id",
        "turn",
        F.size(F.array_compact(trained)).cast("bigint").alias("n_trained"),
        F.aggregate(F.array_compact(trained), zero, lambda a, x: a + x).alias("id_sum"),
    )


@query(
    f"""
WITH t AS (SELECT conv_id, turn, len({TOKENS_SQL.format("(system || ' ' || question)")}) AS p, len({TOKENS_SQL.format('response')}) AS a FROM ({TRIPLES_SQL}))
SELECT conv_id, turn, p::INTEGER AS prompt_tokens, (p + a)::INTEGER AS total_tokens, p <= 60 AND p + a <= 120 AS fits FROM t
"""
)
def length_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = triples(spark, folder).withColumn("prompt", F.concat_ws(" ", "system", "question"))
    return sft.length_budget(rows, "prompt", "response", 60, 120).select(
        "conv_id", "turn", "prompt_tokens", "total_tokens", "fits"
    )


@query(
    """
WITH s AS (SELECT source, doc_id, text, quality + n_chars / 1000000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
b AS (SELECT source, arg_max(text, row(score, -doc_id)) AS chosen, arg_min(text, row(score, doc_id)) AS rejected,
             max(score) AS hi, min(score) AS lo FROM s GROUP BY source)
SELECT source AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM b WHERE hi > lo
"""
)
def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Best and worst document per source, by quality and then length."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = table(spark, folder, "documents").select("doc_id", "source", "text", "n_chars")
    scored = docs.join(labels, "doc_id").withColumn("score", F.col("quality") + F.col("n_chars") / 1000000.0)
    pairs = sft.preference_pairs(scored, "source", "text", "score", "doc_id")
    return pairs.select("prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))
