"""The corpus pipeline over `documents`: quality rules, line deduplication, near duplicates, benchmark decontamination,
tokens. All stages but the last return the columns of `documents`.

In every stage an empty table gives no rows, repeated rows are taken one by one unless the stage says otherwise, texts of any
length are read whole, and other columns pass through untouched, whatever they are called. doc_id is a long or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquant.llm import byte_bpe, decontam, host_quality, jaccard_join, line_dedup
from loomquant.llm.queries import table, tokenizer
from loomquant.llm.storage import bound_batches, stored

MARK = "__llm_"


def _free(docs: DataFrame) -> str:
    """A prefix that no column of `docs` begins with."""
    prefix = MARK
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """`changed` with the columns of `docs`: its column `text` as the text, and n_chars to match where there is one."""
    own = {"text": F.col(text).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return changed.select(*[own.get(c, F.col(c)) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules and their host's evidence reject.

    Null, empty and very short texts fail the base rule and go; a null source is a host of its own; equal rows share their
    verdict; a rate that ties with a tier's bound gets the milder tier at the watch and the stricter one at the block.
    Texts and all other columns stay as they are."""
    bound_batches(spark)
    mark = _free(docs)
    judged = host_quality.judge(docs, keep=docs.columns, prefix=mark)
    return judged.where(F.col(mark + "kept")).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all documents but one, the largest doc_id that holds them; n_chars follows the text.

    A null text counts as one empty line and stays null; a null doc_id counts as one document below all others; rows
    that share a doc_id are one document, each judged on its own lines. No row goes."""
    bound_batches(spark)
    mark = _free(docs)
    keep = [c for c in docs.columns if c != "text"]
    return _with_text(docs, line_dedup.dedup_lines(docs, keep=keep, text_out=True, prefix=mark), mark + "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least doc_id (null least).

    Documents without words, null texts among them, are linked with nothing and all stay; of rows that repeat doc_id and text
    one stays, whichever has the least hash of its columns. Texts are unchanged."""
    bound_batches(spark)
    return jaccard_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of benchmark items out of the texts; n_chars follows the text.

    Overlapping passages are cut once, whole; a null text has no words and becomes an empty one; items without words match
    nothing, and an empty benchmark cuts nothing. No row goes."""
    mark = _free(docs)
    keep = [c for c in docs.columns if c != "text"]
    benchmark = table(spark, sf_dir, "benchmark")
    found = decontam.find_contamination(docs, benchmark, keep=keep, cut=True, prefix=mark)
    return _with_text(docs, found, mark + "clean_text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row.

    Null and empty texts have no tokens and the digests of nothing; of several merges that could come next, the leftmost
    of least rank does."""
    bound_batches(spark)
    return byte_bpe.encode(docs, tokenizer(), keep=["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Byte-pair merges have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
