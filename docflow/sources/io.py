"""Reading and writing documents, runs and logs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docflow import schemas
from docflow.functions.text import stripped, token_count


_OWN_DIR: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Only a local session (tests) may go without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="docflow-"))
        at = _OWN_DIR[0]
    return f"{at}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_pages(docs: DataFrame, lines_a_page: int = 5) -> DataFrame:
    """(doc_id, page_no, text, n_tokens) of docs (doc_id, text): pages of a number of lines. A null text has no page."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size("l") / lines_a_page).cast("int")), lambda p: F.array_join(F.slice("l", (p - 1) * lines_a_page + 1, F.lit(lines_a_page)), "\n"))
    rows = docs.where("text is not null").select("doc_id", lines.alias("l")).select("doc_id", F.posexplode(pages).alias("_i", "text"))
    return rows.select("doc_id", (F.col("_i") + 1).alias("page_no"), "text", token_count(F.col("text")).cast("long").alias("n_tokens"))


def read_markdown(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(doc_id, content): a file a row, named without folder and ending; or by the value of its folder's key (folder=...)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1) if folder is None else F.col(folder).cast("string")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("content"))


def read_elements(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(doc_id, kids) of parsed layouts as JSON files, kids nested as they are; for sections.flat_elements. A file is named as by read_markdown.

    The files are read once, as whole texts, and written as lines of large files. The fields are told from those: Spark's
    own way to tell them from many small files is one task that takes longer for each file the more there are.
    """
    files = read_markdown(spark, path, folder).select("doc_id", F.regexp_replace("content", "^\ufeff|[\r\n]+", " ").alias("content"))
    whole, lines = stored(files.where(stripped(F.col("content")) != ""), "layouts"), shared_path(spark, "layout_lines")
    whole.select("content").write.text(lines)
    shape = spark.read.json(lines).schema
    return whole.select("doc_id", F.explode_outer(F.from_json("content", ArrayType(shape))).alias("x")).select("doc_id", "x.kids")


SESSION = "run_id string, filename string, llm_mode string, created_at string"


def read_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Session records, one a file (or a line, without multi_line), the newest first; what can't be read is left out."""
    rows = spark.read.schema(f"{SESSION}, _bad string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and run_id is not null").drop("_bad").orderBy(F.desc("created_at"))


def read_run_output(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Tasks of written runs, a run or a part of one a line (or a file, with multi_line); a missing, empty or broken file gives none."""
    shape = f"run_id string, tasks array<{schemas.TASK.simpleString()}>, _bad string"
    rows = spark.read.schema(shape).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_bad").option("ignoreMissingFiles", True).json(path)
    return rows.where("_bad is null").select("run_id", F.explode("tasks").alias("t")).select("run_id", "t.*")


def unindexed(requested: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents that have no stored tree yet."""
    return requested.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")


def write_run_output(tasks: DataFrame, report: DataFrame, path: str, most: int = 10_000) -> None:
    """JSON rows under run_id=... folders: the tasks of a run, in parts of about most at most, with its coverage."""
    parts = tasks.groupBy("run_id").agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = tasks.join(parts.hint("merge"), "run_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    own = dealt.groupBy("run_id", "part").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("id", *[c for c in tasks.columns if c not in ("run_id", "id")])]))).alias("tasks"))
    own.join(report.hint("merge"), "run_id", "left").write.mode("overwrite").partitionBy("run_id").json(path)


def write_tree(nodes: DataFrame, path: str, buckets: int = 256) -> None:
    """Trees of documents, in folders by a hash of doc_id so that one document's is found without reading all; in order inside."""
    rows = nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id", "pos").write.mode("append").partitionBy("bucket").parquet(path)


def read_tree(spark: SparkSession, path: str, doc_id: str | None = None, buckets: int = 256) -> DataFrame:
    """Written trees; those of one document from its folder alone."""
    rows = spark.read.parquet(path)
    if doc_id is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id)), F.lit(buckets)).cast("int")).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id))
    return rows.drop("bucket")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select([F.col(f.name).cast(f.dataType) for f in schemas.AUDIT.fields]).write.mode("append").partitionBy("run_id").parquet(path)


def _numbered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """(run_id, value) with the file that a line goes to: the next one once the lines before it and itself are more than most_bytes."""
    sizes: dict = {}
    for batch in batches:
        files = []
        for run, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            number, size = sizes.get(run, (0, 0))
            own = line.as_buffer().size + 1
            number, size = (number + 1, own) if size and size + own > most_bytes else (number, size + own)
            sizes[run] = number, size
            files.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.int32())], names=["run_id", "value", "file"])


def write_log(log: DataFrame, path: str, most_bytes: int = 50_000_000) -> None:
    """JSON lines of all but DEBUG rows, by run, in files of at most most_bytes (a longer line has a file of its own). No shuffle: each task numbers its own files."""
    lines = log.where("level <> 'DEBUG'").select("run_id", F.to_json(F.struct(*[c for c in log.columns if c != "run_id"])).alias("value"))
    kind = log.schema["run_id"].dataType.simpleString()
    lines.mapInArrow(lambda b: _numbered(b, most_bytes), f"run_id {kind}, value string, file int").write.mode("append").partitionBy("run_id", "file").text(path)


def write_payloads(rows: DataFrame, path: str) -> None:
    """Issue payloads, containers before tasks within a run, in files that follow each other in that order; a run of any size is many tasks."""
    rows.repartitionByRange("run_id", "step", "pos").sortWithinPartitions("run_id", "step", "pos").write.mode("overwrite").json(path)
