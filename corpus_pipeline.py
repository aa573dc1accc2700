"""From raw documents to packed training sequences, stage by stage.

A stage takes the documents that the one before kept and returns those that it keeps, with the columns
of `documents`; the last returns the pieces of packed sequences. Every stage's result is a written
table, so a lost executor costs the stage that ran and nothing before.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.debruijn import substring_dedup
from tickloom.llm.exact_dedup import keep_one
from tickloom.llm.hyperminhash import near_duplicates
from tickloom.llm.packing import pack
from tickloom.llm.toxicity import held_out, score, train
from tickloom.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quoted(names: list[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def _rest(docs: DataFrame) -> tuple[list[str], Column]:
    """The columns but id and text, and all of them in one, whatever their names."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return names, F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])


def _as_before(docs: DataFrame, names: list[str]) -> list[Column]:
    """Columns of `docs` from doc_id, text and `rest`."""
    packed_as = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)}
    return [packed_as.get(c, F.col(f"`{c}`")) for c in docs.columns]


def calm(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject. Labels of rows not held out teach them.

    Null and empty texts have a score like any other, that of no evidence. A null id is held out and
    judged; rows that repeat an id or a text are judged each. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    names, rest = _rest(docs)
    scored = score(docs.select("doc_id", "text", rest.alias("rest")), model)
    return scored.filter("predicted = 0").select(*_as_before(docs, names))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    A null text counts as empty, and empty texts are copies of each other. A null id is smaller than any
    other; of rows that repeat the largest id and the text one stays. An empty table stays empty.
    """
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by shingles of five words, the one with the smallest id.

    Texts without words are copies of nothing and stay. Rows that repeat an id stay or go together. Rows
    without an id go if a row with one is near, or another row without. An empty table stays empty.
    """
    kept = near_duplicates(docs, size=5).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that start earlier. Other texts stay as they are, to the byte.

    Every row stays, with a shorter text or an empty one at worst; null stays null. Rows without an id
    come after all others. `n_chars` follows the text, if there is such a column.
    """
    names, _ = _rest(docs)
    found = substring_dedup(docs).select(
        "doc_id",
        F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "rest",
    )
    cut = found.select(*_as_before(docs, names))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*_quoted(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences.

    A null or empty text is one piece, the end token alone. Rows that repeat an id have pieces each.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", calm),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("substring_dedup", passages),
    ("best_fit_packing", packed),
]

#: The stages learn models, look for near copies and pack: not SQL. The tests compare them with
#: brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
