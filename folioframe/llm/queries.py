"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import boilerplate, confusables, ledger, linkage, names, packing, subjects, tokenise
from folioframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records led by one person or organisation whose name is written differently."""
    return names.linked_records(table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "source_content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and page ranges that hold characters a reader would not tell from the plain ones."""
    return confusables.consistent(table(spark, sf_dir, "bib_entry")).filter("changed").select("entry_id", "field_key")


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and page range in its consistent form."""
    return confusables.consistent(table(spark, sf_dir, "bib_entry")).select("entry_id", "field_key", "plain", "changed")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and works that are the same publication, with a confidence."""
    return linkage.matches(spark, table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "catalogue_work"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of record and work that are the same publication."""
    return p4_matches(spark, sf_dir).select("entry_id", "work_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the main body of every web page."""
    return boilerplate.main_body(boilerplate.web_pages(table(spark, sf_dir, "source_content"))).select("content_id", "line_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that are one record in different formatting."""
    return ledger.duplicate_pairs(table(spark, sf_dir, "bib_entry"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with a title once, with its number of copies."""
    return ledger.collapsed(table(spark, sf_dir, "bib_entry"))


def p6_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with its number of copies; a null title equals only a null."""
    return ledger.collapsed(table(spark, sf_dir, "bib_entry"), untitled=True)


def p6_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once with its number of copies, counted in two batches: those loaded within a day, then the late ones."""
    records = table(spark, sf_dir, "bib_entry")
    late = F.coalesce(F.col("loaded_at") > F.col("added_at") + F.expr("INTERVAL 1 DAY"), F.lit(False))
    first, second = (ledger.batch_counts(ledger.keyed(records.filter(c), untitled=True)) for c in (~late, late))
    return ledger.merge_ledger(ledger.merge_ledger(ledger.empty_ledger(spark), first), second).select("entry_id", "copies", "first_at")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return tokenise.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each specification."""
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of the space that is used."""
    return packing.fill(p8_containers(spark, sf_dir), table(spark, sf_dir, "pack_spec"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of the documents for which none are given."""
    return subjects.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_sample"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus by subject area and source: documents and characters."""
    areas = p9_found(spark, sf_dir).unionByName(table(spark, sf_dir, "subject_sample").select("doc_id", "subject_code"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return areas.join(documents, "doc_id").groupBy("subject_code", "source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_plain": p3_plain, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p6_found": p6_found, "p6_counts": p6_counts, "p6_all_counts": p6_all_counts, "p6_incremental": p6_incremental, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_composition": p9_composition}

_KEY = (
    "coalesce('=' || lower(regexp_replace(nfc_normalize({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')), '0')"
)
_KEYED = (
    "SELECT entry_id, added_at, " + " || chr(1) || ".join(_KEY.format(c=c) for c in ledger.KEY_FIELDS) + " AS k "
    "FROM bib_entry WHERE title IS NOT NULL"
)
ORACLE = {
    "p6_found": f"WITH t AS ({_KEYED}) SELECT a.entry_id AS entry_a, b.entry_id AS entry_b FROM t a JOIN t b ON a.k = b.k AND a.entry_id < b.entry_id",
    "p6_counts": f"WITH t AS ({_KEYED}) SELECT (min_by(entry_id, (added_at, entry_id))) AS entry_id, count(*) AS copies, min(added_at) AS first_at FROM t GROUP BY k",
}
ORACLE["p6_incremental"] = ORACLE["p6_all_counts"] = ORACLE["p6_counts"].replace(" WHERE title IS NOT NULL", "")
