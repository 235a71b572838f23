"""Reading documents of several formats into one table, and writing results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters and bytes that an entry point takes at most (fixed values).
LIMITS = {"analyze": 500_000, "public": 200_000, "language": 100_000, "scoring": 50_000}
MOST_BYTES = 25 * 1024 * 1024
Extractor = Callable[[bytes], str]


def format_of(path: Column) -> Column:
    """The format that a path's ending tells; unknown ones are text."""
    end = F.lower(F.substring_index(path, ".", -1))
    return F.when(end == "pdf", "pdf").when(end.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "image").when(end == "docx", "docx").when(end.isin("csv", "json", "md"), end).otherwise("text")


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processor file, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "ignore")
    lines = ["".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)]
    for mark, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        lines = [line.replace(mark, letter) for line in lines]
    return "\n".join(lines)


def read_documents(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, format, length, text, error) of all files under ``path``.

    Texts are UTF-8 with wrong bytes left out; word-processor files are read here, other binary formats by
    ``extractors`` (bytes to text).  A format without one, a file that is too long or can't be read has an error and a
    null text: it fails closed and never passes as it is.  Files without a byte are not listed, as Spark reads none of them.
    """
    known: dict[str, Extractor] = {"docx": docx_text} | (extractors or {})
    plain = ("text", "csv", "json", "md")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, errors = [], []
            for kind, n, content in zip(rows["format"], rows["length"], rows["content"], strict=True):
                text, error = None, None
                if n > most_bytes:
                    error = "too long"
                elif kind in plain:
                    text = bytes(content).decode("utf-8", "ignore")
                elif kind not in known:
                    error = f"no extractor for {kind}"
                else:
                    try:
                        text = known[kind](bytes(content))
                    except Exception as e:  # noqa: BLE001  a file of any kind may be broken
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": rows["path"], "format": rows["format"], "length": rows["length"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", format_of(F.col("path")).alias("format"), "length", "content").mapInPandas(extract, "path string, format string, length long, text string, error string")


def as_blocks(documents: DataFrame) -> DataFrame:
    """Documents of (doc_id, text) as their lines: (doc_id, block, text, start_index, end_index)."""
    from pyspark.sql import Window

    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("start_index", before).withColumn("end_index", F.col("start_index") + F.length("text"))


def within_limit(docs: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """Documents that an entry point takes, and those that are too long for it."""
    fits = F.coalesce(F.length("text"), F.lit(0)) <= LIMITS[entry]
    return docs.filter(fits), docs.filter(~fits)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """A suite of test documents with their expected entities, from a JSON array."""
    schema = "id string, type string, content string, expected_entities array<struct<type:string,value:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_texts(docs: DataFrame, path: str, kind: str = "json") -> None:
    """(doc_id, redacted_text) as JSON lines, CSV with quotes doubled, or Parquet."""
    writer = docs.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    elif kind in ("json", "parquet", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def compliance_rows(logs: DataFrame) -> DataFrame:
    """Audit rows as a compliance report has them: rules in one field, times as text."""
    return logs.select("id", "name", "status", "entities", F.array_join("rules", "; ").alias("rules"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) of ``manifest`` (name, sha256): ok, changed or missing."""
    got = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("got"))
    return manifest.join(got, "name", "left").select("name", F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("changed").alias("status"))
