"""The registered queries of the operators, ``opN_<name>``.

Each is a thin wrapper: it reads its whole table, applies the operator with
production parameters and derives the result columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The identifier of a table's rows, by which they are dealt.
KEYS = {"documents": "doc_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores, and so a small one, is dealt over all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, KEYS[name])
    return rows


def _is(value: str):
    return lambda x: x == value


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.pii import BASE, KINDS, find, fit

    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))

    def joined(*kinds: str):
        ordered = F.concat(*(F.array_sort(F.transform(F.filter("spans", _of(k)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))) for k in kinds))
        return F.when(F.size("spans") > 0, F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")).otherwise("")

    base = [k for k, _ in BASE]
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(*base).cast("binary"), 256).alias("base_sha256"), joined(*KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, contaminated, items, cover`` for every document."""
    from stocktake.llm.decontamination import contaminated

    docs = table(spark, sf_dir, "documents")
    bad = contaminated(docs, table(spark, sf_dir, "benchmark"))
    every = docs.select("doc_id").join(bad.withColumnRenamed("doc_id", "bad_id"), F.col("doc_id").eqNullSafe(F.col("bad_id")), "left")
    items = F.array_join(F.coalesce("items", F.array().cast("array<bigint>")).cast("array<string>"), ",")
    return every.select("doc_id", F.col("items").isNotNull().alias("contaminated"), items.alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.context_tree import score

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.bpe_codec import round_trip

    coded = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.suffix_dedup import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.secrets import KINDS, find_secrets, joined

    found = find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), share=85, width=5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocktake.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP4 = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 10
"""

_OP9 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least_of.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(least_of.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of ON least_of.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op4_nearest": _OP4, "op9_near_duplicates": _OP9}
