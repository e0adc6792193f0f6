"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, secrets are masked, sources are mixed to their targets, and the result is packed into sequences.

A stage takes (spark, docs, sf_dir), docs a stored table, and gives back rows with the columns of
docs; the last gives pieces of sequences. Stages find their decisions' rows by a number that is
written into the table first, so that it does not hang on how a read splits the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import mixing, neardup, packing, secrets, toxicity
from cairnframe.llm.common import sifted, stored, table

def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, fitted on those labelled, finds toxic; null and empty texts stay, and repeated rows are judged alike."""
    model = toxicity.fit(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep_text=True).where(~F.col("toxic")).select("row.*")


def _placed(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct ``row`` with a unique ``place``, written once: both sides of a join by it read the same numbers."""
    return stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "placed")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id (null last), of each group of near-duplicates; of repeated rows one stays, texts that are null or without words all do."""
    placed = _placed(docs)
    found = neardup.near_duplicates(placed.select("row.doc_id", "row.text", "place"), place="place")
    gone = stored(found.where(~F.col("kept")).select(F.col("place").alias("gone")), "gone")
    maybe, not_gone = sifted(placed, F.col("place"), gone, "gone")
    stay = maybe.join(gone.hint("merge"), F.col("place") == F.col("gone"), "left_anti")
    return stay.unionByName(not_gone).select("row.*")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for what the secret scan reports, and n_chars of the new text; null texts stay null."""
    found = secrets.scan(docs, keep_text=True)
    clean = found.withColumn("masked", secrets.masked(F.col("row.text"), F.col("spans")))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("masked")}
    return clean.select(*[F.when(F.size("spans") > 0, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; without words, not at all. Repeated rows are taken each on its own."""
    placed = _placed(docs)
    mix = mixing.mix(placed.select("row.source", "row.text", "place"))
    taken = stored(mix.where(F.col("copies") > 0).select(F.col("row.place").alias("taken"), "copies"), "copies")
    # Nearly all rows are taken, so the texts are shuffled at every size.
    copies = placed.join(taken.hint("merge"), F.col("place") == F.col("taken"))
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op3_packing gives them."""
    return packing.query(docs)


STAGES = [("toxicity", toxic_out), ("near_dedup", one_of_each), ("secret_scans", secrets_masked), ("mixing", mixed), ("packing", packed)]

#: Fitted models, sketches and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
