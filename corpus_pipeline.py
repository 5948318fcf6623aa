"""A pipeline over ``documents``: toxic texts go, one of each group of near copies stays, contaminated texts go, secrets are
masked, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame.  All but the last
return the columns of ``documents``.  Rows without an id or text, and rows that repeat, go through every stage as documents
of their own; empty tables give an empty result; an empty ``labels`` or ``benchmark`` lets every document through its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import decontamination, near_dedup, packing, secret_scan, toxicity
from trackweave.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose predicted label isn't toxic; the model learns from the labelled ones of this stage's input, and
    without any it keeps all."""
    model = toxicity.train(toxicity.labelled_rows(docs, _table(spark, sf_dir, "labels"), "toxic", 4, 2))
    kept = toxicity.scored(docs, model, keep=COLUMNS).where("predicted = 0")
    return kept.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, similarity 0.8): the one with the smallest doc_id, rows without an id
    last, the first in the table among equals.  Rows count one by one, also where they repeat an id; texts without words stay."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    found = written(near_dedup.near_duplicates(rows, doc_id="__row").where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id"), "groups")
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = found.join(groups, "component_id").join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = members.groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    copies = members.select("__row").join(first, "__row", "left_anti")
    return rows.join(copies, "__row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the benchmark's windows don't contaminate."""
    judged = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"), keep=COLUMNS[2:])
    return judged.where("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mask and counts the code points anew where a text changed."""
    found = secret_scan.scan(docs, keep=COLUMNS)
    text = secret_scan.redacted("text", "spans")
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    import public_tokenizers

    parts = written(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Models, tokenizers and packing aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if number == len(STAGES) - 1 else written(out, f"stage-{name}")
    return docs
