"""Documents from files. Every reader gives file, offset, length (where a document lies in its file) and text.

Record readers work on rows of file(path, content), so the bytes can come from files or from a table.
"""

import struct
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T

_DOCS = "file string, offset bigint, length bigint, text string"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file, size: all regular files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """file, content: whole files (each up to 2 GB) below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file; its length is in characters."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("offset"), F.length("value").cast("bigint").alias("length"), F.col("value").alias("text"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """raw: a query for each line."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def sentences(docs: DataFrame) -> DataFrame:
    """file, offset, length, text of docs(file, text): pieces between ! . and ? that hold more than one word (stop words don't
    count). Offsets are in characters, each mark counting as one. file tells rows apart; a null text has no pieces."""
    rows = docs.select("file", F.posexplode(F.split("text", "[!.?]")).alias("nth", "text"))
    before = "coalesce(sum(length(text) + 1) over (partition by file order by nth rows between unbounded preceding and 1 preceding), 0)"
    rows = rows.selectExpr("file", f"cast({before} as bigint) as offset", "cast(length(text) as bigint) as length", "text")
    return rows.where(T.longer_than(T.words("text"), 1))


#: Bytes of content that a record reader unpacks at once.
SLICE = 16_000_000


def _slices(batches):
    """The batches of (file, content) in slices of bounded content: a batch is bounded in rows only."""
    for b in batches:
        sizes = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held + n > SLICE and i > start:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(b):
            yield b.slice(start)


def inflated(files: DataFrame) -> DataFrame:
    """file, content with gzip undone (several members too); content that is no gzip becomes null."""

    def run(batches):
        for b in _slices(batches):
            out = []
            for content in b.column(1).to_pylist():
                try:
                    parts = []
                    while content:
                        d = zlib.decompressobj(31)
                        parts.append(d.decompress(content) + d.flush())
                        if not d.eof:
                            raise zlib.error("incomplete")
                        content = d.unused_data
                    out.append(b"".join(parts))
                except (zlib.error, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    return files.select("file", "content").mapInArrow(run, "file string, content binary")


def length_delimited(files: DataFrame) -> DataFrame:
    """Documents of files(file, content) that hold records of a big-endian unsigned 32-bit length and so many bytes of UTF-8
    (wrong bytes are replaced); offsets and lengths are in bytes, behind the prefix. A file that ends within a record
    has no documents at all."""

    def run(batches):
        for b in _slices(batches):
            rows = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, at, content = [], 0, content or b""
                while at + 4 <= len(content):
                    (n,) = struct.unpack_from(">I", content, at)
                    if at + 4 + n > len(content):
                        break
                    found.append((file, at + 4, n, content[at + 4 : at + 4 + n].decode("utf-8", "replace")))
                    at += 4 + n
                if at == len(content):
                    rows += found
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "offset", "length", "text"])

    return files.select("file", "content").mapInArrow(run, _DOCS)


def length_delimited_gzip(files: DataFrame) -> DataFrame:
    return length_delimited(inflated(files))


def archive_pages(files: DataFrame) -> DataFrame:
    """file, offset, length, text of files(file, content) of concatenated <DOC> records: the html between the end of a record's
    header block and the end of the record, as text. Offsets and lengths are in characters of the content (lenient UTF-8);
    the record's text runs to its end if either mark is missing. What stands before the first record is a page as well."""
    rows = files.select("file", F.decode("content", "UTF-8").alias("content") if dict(files.dtypes)["content"] == "binary" else "content")
    rows = rows.where("content is not null").select("file", F.posexplode(F.split("content", "<DOC>")).alias("nth", "page"))
    rows = rows.withColumn("page", F.expr("if(nth = 0, page, concat('<DOC>', page))")).where("nth > 0 or page <> ''")
    before = "coalesce(sum(length(page)) over (partition by file order by nth rows between unbounded preceding and 1 preceding), 0)"
    rows = rows.selectExpr("file", f"cast({before} as bigint) as offset", "cast(length(page) as bigint) as length", "page")
    body = F.expr("if(instr(page, '</DOCHDR>\n') > 0, substring(page, instr(page, '</DOCHDR>\n') + 10), '')")
    body = F.substring_index(body, "</DOC>\n", 1)
    return rows.select("file", "offset", "length", H.html_to_text(body).alias("text"))


def archive_pages_gzip(files: DataFrame) -> DataFrame:
    return archive_pages(inflated(files))


def fragment_text(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """fragments(file, offset, length, ...) with text cut out of texts(file, text); a fragment of an unknown file gets null."""
    whole = texts.select("file", F.col("text").alias("__whole"))
    return fragments.join(whole, "file", "left").withColumn("text", F.expr("substring(__whole, cast(offset + 1 as int), cast(length as int))")).drop("__whole")
