"""A training-data pipeline out of the corpus operators.

Documents that are scored toxic go; of near duplicates the smallest id stays; documents that
leak benchmark items go; personal data is replaced by its kind; the last stage adds the rate
and the number of copies with which each document enters the mix.

Every stage works on columns of its own names and on row keys that it makes itself, so ids may be null or
repeated and other columns may have any name; they come out as they went in. A null text
is empty to the models, and stays null. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionframe.llm.common import stored, table
from fusionframe.llm.decontaminate import find_leaks
from fusionframe.llm.mixing import mix_sources
from fusionframe.llm.ngram_join import ngram_join
from fusionframe.llm.pii import find_pii
from fusionframe.llm.toxicity import fit_toxicity, score_toxicity

#: Shares of the tokens by quality and toxicity label; the filter before leaves no place for toxic ones.
TARGETS = {"q0t0": 0.06, "q0t1": 0.0, "q1t0": 0.94, "q1t1": 0.0}


class Plain:
    """The rows of documents under column names that clash with nothing."""

    def __init__(self, docs: DataFrame):
        self.names = [f"in_{k}" for k in range(len(docs.columns))]
        self.at = dict(zip(docs.columns, self.names))
        self.columns, self.rows = docs.columns, docs.toDF(*self.names)

    def keyed(self) -> DataFrame:
        """The rows with row_key, in a table, so that a key stays with its row."""
        return stored(self.rows.withColumn("row_key", F.monotonically_increasing_id()))

    def named(self, rows: DataFrame, *more: str) -> DataFrame:
        """The columns of the documents under their own names, then others."""
        return rows.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.columns)], *more)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is under 0.5; the model learns from the labels of all documents of the table.

    Empty and null texts have a score like any other; repeated rows stay or go together; very long texts are scored whole.
    """
    plain = Plain(docs)
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = score_toxicity(plain.rows, model, text_col=plain.at["text"], keep=plain.names)
    return plain.named(scored.where("score < 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the smallest id (null comes last), and of these the first.

    Rows of one id with different texts are different documents; repeated rows are copies. Rows without
    words are near nothing, and all stay.
    """
    plain = Plain(docs)
    keyed = plain.keyed()
    classes = ngram_join(keyed, id_col="row_key", text_col=plain.at["text"]).select("row_key", "class_id")
    own = keyed.select("row_key", F.col(plain.at["doc_id"]).alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))["row_key"]
    kept = classes.join(own, "row_key").groupBy("class_id").agg(first.alias("row_key")).select("row_key")
    return plain.named(keyed.join(kept, "row_key", "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that leak no benchmark item; null and empty texts leak nothing, repeated rows stay or go together."""
    plain = Plain(docs)
    keyed = plain.keyed()
    leaks = find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="row_key", text_col=plain.at["text"]).select(F.col("doc_id").alias("row_key")).distinct()
    return plain.named(keyed.join(leaks, "row_key", "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters anew; rows without any, null and empty texts stay as they are."""
    plain = Plain(docs)
    text, n_chars = plain.at["text"], plain.at.get("n_chars")
    found = find_pii(plain.rows, text_col=text, redact=True, keep=plain.names)
    changed = F.size("spans") > 0
    found = found.withColumn(text, F.when(changed, F.col("redacted")).otherwise(F.col(text)))
    if n_chars:
        found = found.withColumn(n_chars, F.when(changed, F.length("redacted").cast(plain.rows.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return plain.named(found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds mix_tokens, mix_rate and mix_copies: the whole part of the rate, and one more with the rest as chance, by a hash of id and text.

    Repeated rows have the same numbers; an empty or null text has no tokens and the rate of its posterior.
    """
    plain = Plain(docs)
    keyed = plain.keyed()
    rates = mix_sources(keyed, table(spark, sf_dir, "labels"), TARGETS, id_col="row_key", text_col=plain.at["text"], doc_label_id=plain.at["doc_id"])
    rates = rates.select("row_key", F.col("n_tokens").alias("mix_tokens"), F.round("rate", 6).alias("mix_rate"))
    chance = F.pmod(F.xxhash64(plain.at["doc_id"], plain.at["text"]), F.lit(1 << 20)) / float(1 << 20)
    rate = F.col("mix_rate")
    copies = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
    return plain.named(keyed.join(rates, "row_key"), "mix_tokens", "mix_rate", copies.alias("mix_copies"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: No stage but the last joins can be said in SQL: models and alignments are fitted and run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
