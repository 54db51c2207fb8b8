"""A corpus pipeline: language ID, quality classifier, near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and what it returns
is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, packing, quality, shingles
from graphloom.llm.common import load, materialize

#: SQL can express neither the language model, the perplexities nor the tokenizer.
ORACLE_SQL = None
#: Below this share of the best language a text counts as of no language; a lone unseen word of four languages has about a half.
LEAST_SCORE = 0.4


def _plain(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that no language explains; lang becomes the predicted one."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    columns = _plain(docs)
    found = langid.predict(docs, model, columns).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*columns)


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity lies outside their language's limits."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    columns = _plain(docs)
    same = F.xxhash64("lang", "text")  # rows repeated under an id but of other text are judged apart
    scored = quality.classify(docs.withColumn("_same_", same), labels, ["doc_id", "_same_"])
    gone = materialize(scored.where("not kept").select(F.col("doc_id").alias("_id_"), "_same_").distinct(), "rejected")
    rows = docs.select(*columns, same.alias("_row_"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id_"]) & (rows["_row_"] == gone["_same_"]), "left_anti").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word Jaccard similarity of 0.8 or more the document of smallest doc_id stays; of rows repeated under it the least by its other columns. Rows without an id stay."""
    columns = _plain(docs)
    found = shingles.similar(docs.select("doc_id", "text"), width=5, least=0.8)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.select(*columns).join(gone.select(F.col("doc_id").alias("_id_")), F.col("doc_id").eqNullSafe(F.col("_id_")), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = materialize(repeated.join(gone, "doc_id", "left_anti"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*columns)
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in columns if c != "doc_id"])).alias("_row_"))
    return once.unionByName(least.select("doc_id", "_row_.*").select(*columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs.select("doc_id", "text"), **packing.files())


STAGES = [("language ID", language), ("quality classifier", good_text), ("SimHash near-dedup", near_dedup), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the table documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
