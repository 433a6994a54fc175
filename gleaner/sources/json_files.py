"""JSON interchange files: gold corpora, runs, self-checks, seeds.

A seed document holds a run's header and a list of its pages. So that no run
is ever gathered into one row, a large run is written as several documents
with the same header and about ``pages_per_document`` pages each; a run below
that is one document. Reading merges them by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SETTLED_PARSE
from ..functions.basic import strip
from ..operators.joins import spread_join
from ..schema import (
    CHECK_FILE,
    GOLD_ENTRY,
    PAGE_RESULTS,
    PAGE_RESULTS_COLUMNS,
    RUN_FILE,
    RUNS,
    SEED_FILE,
    conform,
    run_id_of,
)

HEADER = [f.name for f in SEED_FILE.fields if f.name != "pages"]


BAD = "_bad_record"


def _read(spark: SparkSession, path: str, schema: T.StructType, one_per_line: bool = False) -> DataFrame:
    """Pretty-printed documents are read a file at a time, others line by line and splittable.

    An empty file yields no row. A document that is broken or of another type
    fails the job; ``bad_records`` tells which.
    """
    reader = spark.read.schema(schema).option("multiLine", not one_per_line).option("mode", "FAILFAST")
    return reader.json(path)


def bad_records(spark: SparkSession, path: str, schema: T.StructType, one_per_line: bool = False) -> DataFrame:
    """The documents a reader would fail on: the file's name and the text as it stands."""
    marked = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(marked).option("multiLine", not one_per_line).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", BAD).json(path)
    # All columns take part, else Spark would not parse them and find nothing wrong.
    read = rows.select(F.col("_metadata.file_name").alias("file"), F.col(BAD).alias("text"), F.xxhash64(*[c for c in schema.names if c != BAD]).alias("_all"))
    return read.where(F.col("text").isNotNull() & (F.col("_all") != 0)).select("file", "text")


def read_gold(spark: SparkSession, path: str, ordered: bool = False, one_per_line: bool = False) -> DataFrame:
    """Entries of all gold files under a path or glob.

    ``ordered`` sorts them by domain and URL, which moves the HTML; the jobs
    do not need it. An entry without a URL fails the job.
    """
    entries = _read(spark, path, GOLD_ENTRY, one_per_line)
    message = F.concat(F.lit("gold entry without a URL in "), F.col("_metadata.file_name"))
    named = F.when(F.col("url").isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    kept = entries.where(named)
    return kept.orderBy("domain", "url") if ordered else kept


def _file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_runs(
    spark: SparkSession, path: str, label: str | None = None, one_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Run files as (runs, page results).

    A run's label is its file name; ``label`` names the run of a single file and
    is ignored when there are several. With ``one_per_line`` a file holds its
    run in several documents with the same header.
    """
    documents = _read(spark, path, RUN_FILE, one_per_line)
    named = F.lit(label) if label and len(documents.inputFiles()) == 1 else _file_stem()
    files = documents.select("*", named.alias("label"))
    header = files.select(
        run_id_of(F.col("label")).alias("run_id"),
        "label",
        F.col("model").alias("model_name"),
        "provider",
        F.col("condition").alias("condition_name"),
        "budget_tokens",
        "eur_per_usd",
    )
    if one_per_line:
        header = header.distinct()
    records = files.select(run_id_of(F.col("label")).alias("run_id"), F.explode("records").alias("r")).select(
        "run_id", "r.*"
    )
    renamed = records.withColumnsRenamed(
        {"precision": "precision_val", "recall": "recall_val", "error": "note"}
    )
    return conform(header, RUNS), conform(renamed, PAGE_RESULTS)


def read_raw_replies(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Replies as they arrived, one row each, of runs that kept them."""
    files = _read(spark, path, RUN_FILE, one_per_line).select(_file_stem().alias("label"), F.explode("records").alias("r"))
    return files.select("label", "r.url", F.posexplode("r.raw_responses").alias("n", "raw"))


def read_checks(spark: SparkSession, path: str, run_label: str, one_per_line: bool = False) -> DataFrame:
    """Self-check results, addressed to the run they were made for."""
    files = _read(spark, path, CHECK_FILE, one_per_line)
    return files.select(F.explode("results").alias("r")).select(
        run_id_of(F.lit(run_label)).alias("run_id"), "r.*"
    )


def read_seeds(
    spark: SparkSession, path: str, one_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Seed documents as (runs, page results); unknown columns are ignored, missing ones NULL.

    ``one_per_line`` reads what ``write_seeds`` wrote. A document without a
    label fails the job.
    """
    documents = _read(spark, path, SEED_FILE, one_per_line)
    message = F.concat(F.lit("seed document without a label in "), F.col("_metadata.file_name"))
    named = F.when(F.col("label").isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    documents = documents.where(named)
    run_id = run_id_of(F.col("label")).alias("run_id")
    header = documents.select(run_id, *HEADER).dropDuplicates(["run_id"])
    pages = documents.select(run_id, F.explode("pages").alias("p")).select("run_id", "p.*")
    created = F.col("created_at").try_cast("timestamp_ntz")
    return conform(header.withColumn("created_at", created), RUNS), conform(pages, PAGE_RESULTS)


def slug(label: Column) -> Column:
    """A run's file name: lower case, anything but letters and digits an underscore."""
    return F.coalesce(
        F.nullif(F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]", "_")), F.lit("")), F.lit("run")
    )


def seed_documents(
    runs: DataFrame,
    page_results: DataFrame,
    pages_per_document: int = 1_000,
    chars_per_document: int = 16 << 20,
) -> DataFrame:
    """Runs as nested documents: the header, ``part`` and a list of pages.

    Parts are filled by a hash of the URL, so no list grows with the run; there
    are as many as keep a document to about ``pages_per_document`` pages and
    ``chars_per_document`` characters of text.
    """
    text = F.length("parsed_text") if "parsed_text" in page_results.columns else F.lit(0)
    sizes = page_results.groupBy("run_id").agg(F.count("*").alias("_pages"), F.sum(text).alias("_chars"))
    parts = F.greatest(
        F.ceil(F.col("_pages") / pages_per_document), F.ceil(F.col("_chars") / chars_per_document)
    ).cast("int")
    sized = runs.join(sizes, "run_id", "left").select(
        "run_id", *HEADER, F.greatest(F.lit(1), F.coalesce(parts, F.lit(1))).alias("_parts")
    )
    columns = [f.name for f in PAGE_RESULTS_COLUMNS.fields if f.name in page_results.columns]
    with_part = spread_join(
        page_results.select("run_id", *columns), sized.select("run_id", "_parts"), ["run_id"], ["url"]
    ).withColumn("part", F.pmod(F.xxhash64("url"), F.col("_parts")).cast("int"))
    lists = with_part.groupBy("run_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("pages")
    )
    # Small rows without their lists first, so headers of runs without pages stay.
    every_part = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    element = lists.schema["pages"].dataType
    return every_part.join(lists, ["run_id", "part"], "left").select(
        slug(F.col("label")).alias("slug"),
        "part",
        *HEADER,
        F.coalesce("pages", F.array().cast(element)).alias("pages"),
    )


def write_seeds(
    runs: DataFrame,
    page_results: DataFrame,
    path: str,
    pages_per_document: int = 1_000,
    chars_per_document: int = 16 << 20,
) -> None:
    """A folder per run, one document per line."""
    documents = seed_documents(runs, page_results, pages_per_document, chars_per_document)
    documents.drop("part").write.mode("overwrite").partitionBy("slug").json(path)


def write_run_results(pages: DataFrame, records: DataFrame, path: str, format: str = "parquet") -> None:
    """A run's settled records in the order of the corpus (domain, URL)."""
    settled = records.where(F.col("status").isin(*SETTLED_PARSE))
    known = settled.join(pages.select("url"), "url", "left_semi")
    known.sort("domain", "url").write.mode("overwrite").format(format).save(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Wanted URLs from a text file: blank lines and lines starting with # do not count."""
    listed = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return listed.select(strip("value").alias("url")).where("url <> ''").distinct()
