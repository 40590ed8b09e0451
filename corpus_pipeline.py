"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as Parquet, and all but the last return the columns of documents:

1. language: documents whose text has no letters, or whose language stays uncertain, go;
2. lines: blocks that an earlier document has too are deleted; documents left without words by that go;
3. near_duplicates: one document of each group stays, that of the least id;
4. mixing: documents are repeated and ordered so that sources reach their temperature weights; none is dropped;
5. packing: documents are cut into sequences of power-of-two lengths. (mix_file, mix_row, start) is the order that mixing
   gave them, block after block; sequence_id only names a sequence.

Defined cases: null texts and ids, empty tables and repeated rows are handled as the operators state. Rows of a null id
pass the third stage unchanged; rows that repeat an id leave it once. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import langid, linedup, minhash, mixing, packing
from riskloom.llm._common import Scratch, table
from riskloom.llm.queries import PIECES, WORDS, held_out

#: Posterior that a document's language must reach.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    model = langid.fit(langid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", may_learn=~held_out(F.col("doc_id")), docs_per_language=250, longest=20_000), path)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    scored = langid.predict(docs, model, path, keep={k: docs[c] for k, c in names.items()})
    sure = scored.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= CERTAIN))
    return sure.select(*[F.col(k).alias(c) for k, c in names.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linedup.dedup(docs, Scratch(spark, "pipeline-lines"))
    found = found.where((F.col("_removed_words") == 0) | F.col("text").rlike("\\S"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("_removed_words") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen = minhash.groups(docs, Scratch(spark, "pipeline-near")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = docs.hint("merge").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    uses = mixing.mix(docs, Scratch(spark, "pipeline-mixing")).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("position").alias("_position"))
    placed = docs.hint("merge").join(uses, docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")))
    return placed.orderBy("_block", "_position").select(*docs.columns)


def places(docs: DataFrame) -> dict[str, Column]:
    """Where rows read from Parquet stand: the number of the file and the row in it, which follow the order that they were
    written in, whatever the order of reading; null for rows from elsewhere."""
    nothing = {"mix_file": F.lit(None).cast("long"), "mix_row": F.lit(None).cast("long")}
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:  # the rows went through other operators since
        return nothing
    task, piece = (F.regexp_extract("_metadata.file_name", rule, 1).try_cast("long") for rule in ("^part-(\\d+)", "-c(\\d+)[^-]*$"))
    return {"mix_file": task * F.lit(1 << 20) + F.coalesce(piece, F.lit(0)), "mix_row": F.col("_metadata.row_index").cast("long")}


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, public_tokenizers.path(WORDS), keep=places(docs))
    return packed.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "mix_file", "mix_row", "token_bytes")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages use hashes, tokenizers and alignments that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage written and read again in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
