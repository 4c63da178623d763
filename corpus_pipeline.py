"""A training-corpus pipeline over documents.

Five stages, each over all that the one before has kept: language identification, near-duplicate removal by Jaccard
join, removal of repeated passages, mixing of sources to target weights, byte-level BPE encoding. Every stage is
written as Parquet to the shared folder and read again as the next one's docs. All but the last return the columns of
documents; where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedalflow.llm import bpe, jaccard, langid, mixing, substring
from pedalflow.llm.shared import WORD, materialise, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The share of a text's n-grams that its language must know.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: null, without any letter, or of whose n-grams no language knows
    LEAST_SCORE, however short they are. The model is learned from the stage's own documents; kept ones, repeated rows
    too, stay as they are. An empty table gives no rows."""
    prepare(spark)
    model = langid.learn_from_documents(docs)
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document stays, that with the smallest id; of a component without any
    id, one text. Rows that share an id are told apart by their components, so each component keeps a row of its own;
    rows that are alike are one document. Null and empty texts are linked with nothing and stay. An empty table gives no
    rows."""
    prepare(spark)
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))
    found = jaccard.near_duplicates(keyed, carry=("_key",))
    # Rows that share an id may be of several components, and a text without words is its own.
    alone = F.when(F.col("class").isNull(), F.col("_key")).alias("_alone")
    named = found.where("doc_id = component_id").groupBy("component", "doc_id", alone).agg(F.min("_key").alias("_key")).select("doc_id", "_key").distinct()
    nameless = found.where("component_id is null and (class is null or class = component)")
    # Texts of one class may differ; the smallest key of each stays.
    nameless = nameless.groupBy("class").agg(F.min("_key").alias("_key")).select(F.lit(None).cast("long").alias("doc_id"), "_key")
    chosen = named.unionByName(nameless).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_kept"))
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["_id"]) & (keyed["_key"] == chosen["_kept"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("lang", "source", "n_chars"))
    return kept.withColumn("_n", once).where("_n = 1").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that a document with a smaller id has too. A document that loses none keeps its
    text as it is; one that loses all its words goes. Rows without an id, and null or empty texts, stay as they are;
    repeated rows lose the same words. An empty table gives no rows."""
    prepare(spark)
    found = substring.remove_repeats(docs.select("doc_id", F.struct("lang", "source", "n_chars", F.col("text").alias("whole")).alias("doc"), "text"))
    changed = F.col("n_removed") > 0
    return found.where("n_removed = 0 or n_removed < n_words").select(
        "row.doc_id",
        F.when(changed, F.col("kept")).otherwise(F.col("row.doc.whole")).alias("text"),
        "row.doc.lang",
        "row.doc.source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.doc.n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it whole, and where the mix takes a part of it adds its first
    words once more, joined by one space. Documents that the mix doesn't take go, and so do those without words, null
    texts among them. A null source is a source; ties in the order go by id, then size. Of rows that share id, text and
    source one stands for all and takes their shares. An empty table gives no rows."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))
    taken = mixing.mix(keyed, keep=("_key",)).where("taken > 0")
    # Rows that share id and text are alike; their shares go to one of them.
    total = taken.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), F.col("source").alias("_source"), "size").agg(F.sum("taken").alias("taken"))
    same = keyed["doc_id"].eqNullSafe(total["_id"]) & (keyed["_key"] == total["_of"]) & keyed["source"].eqNullSafe(total["_source"])
    once = F.row_number().over(Window.partitionBy("doc_id", "_key", "source").orderBy("lang", "n_chars"))
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = keyed.join(total, same).withColumn("_n", once).where("_n = 1").withColumn("_words", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words")), " ")
    cut = F.col("_words") > 0
    rows = rows.withColumn("_text", F.when(cut, first).otherwise(F.col("text")))
    return rows.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(cut, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as counts and digests: doc_id, lang, source, n_tokens,
    ids_sha256, decoded_sha256. Null and empty texts have no ids; repeated rows come out each. An empty table gives no
    rows."""
    prepare(spark)
    return bpe.digests(docs, bpe.RANKS, ["doc_id", "lang", "source"])


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated-passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]
#: SQL can't express the language model or the tokenizer; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
