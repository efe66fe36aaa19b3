"""Files as documents (decoded, classified, refused with a reason) and a store of contents by SHA-256 with zstd tiers."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Zstd levels of the tiers.
LEVELS = {"HOT": 1, "WARM": 6, "COLD": 19}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of all files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def decoded(found: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    """The columns of `found` with source_type, text and error in place of content: text of Markdown and TXT files (UTF-8, a byte order mark is dropped, lines end in \\n).

    What is too large, binary, not UTF-8, of another kind, or a PDF by another name has an error and no text; PDFs are recognised by name and first bytes
    and carry PDF_NEEDS_READER, since no PDF reader is at hand. Null contents count as empty.
    """
    raw = F.coalesce("content", F.lit(b""))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    pdf = F.startswith(raw, F.lit(b"%PDF-"))
    kind = F.when(suffix == ".pdf", "PDF").when(suffix.isin(".md", ".markdown"), "MARKDOWN").when(suffix == ".txt", "TXT")
    body = F.when(F.startswith(raw, F.lit(b"\xef\xbb\xbf")), F.substring(raw, F.lit(4), F.octet_length(raw))).otherwise(raw)
    d = found.withColumns({"source_type": kind, "_pdf": pdf, "_bytes": raw, "_text": F.try_validate_utf8(body.cast("string"))})
    error = (
        F.when(F.octet_length("_bytes") > most, "TOO_LARGE").when(F.col("source_type").isNull(), "KIND_NOT_ACCEPTED").when((F.col("source_type") == "PDF") & ~F.col("_pdf"), "PDF_MAGIC_MISSING")
        .when((F.col("source_type") != "PDF") & F.col("_pdf"), "PDF_BY_ANOTHER_NAME").when(F.col("source_type") == "PDF", "PDF_NEEDS_READER")
        .when(F.contains("_bytes", F.lit(b"\x00")), "BINARY").when(F.col("_text").isNull(), "NOT_UTF8")
    )
    d = d.withColumn("error", error)
    keep = [c for c in found.columns if c != "content"]
    return d.select(*keep, "source_type", F.when(F.col("error").isNull(), F.regexp_replace("_text", "\r\n?", "\n")).alias("text"), "error")


def _packed(spark: SparkSession, content: Column, level: int) -> Column:
    ship(spark)

    @F.pandas_udf("binary")
    def pack(b: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=level, write_checksum=True)
        return b.map(z.compress)

    return pack(content)


def _unpacked(spark: SparkSession, blob: Column) -> Column:
    """The content, null if the blob is no whole zstd frame."""
    ship(spark)

    @F.pandas_udf("binary")
    def unpack(b: pd.Series) -> pd.Series:
        z = zstandard.ZstdDecompressor()

        def one(x):
            try:
                return z.decompress(x)
            except zstandard.ZstdError:
                return None

        return b.map(one)

    return unpack.asNondeterministic()(blob)  # else a filter on the content unpacks it once more


def put(contents: DataFrame, tier: str = "HOT", content: str = "content") -> DataFrame:
    """(sha256, logical_size, physical_size, tier, blob) of each distinct content, compressed once. Copies meet before they are compressed; null counts as empty."""
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    once = contents.select(F.sha2(raw, 256).alias("sha256"), raw.alias("_c")).groupBy("sha256").agg(F.first("_c").alias("_c"))
    packed = once.select("sha256", F.octet_length("_c").cast("long").alias("logical_size"), _packed(contents.sparkSession, F.col("_c"), LEVELS[tier]).alias("blob"))
    return packed.select("sha256", "logical_size", F.octet_length("blob").cast("long").alias("physical_size"), F.lit(tier).alias("tier"), "blob")


def read_verified(store: DataFrame) -> DataFrame:
    """(sha256, content): contents whose size and hash are those recorded; anything else is an error, also for a reader who drops the content."""
    c = store.select("sha256", "logical_size", _unpacked(store.sparkSession, F.col("blob")).alias("content"))
    whole = (F.octet_length("content") == F.col("logical_size")) & (F.sha2("content", 256) == F.col("sha256"))
    bad = F.raise_error(F.concat(F.lit("content does not match its hash: "), F.coalesce("sha256", F.lit("none")))).cast("boolean")
    return c.where(F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(bad)).select("sha256", "content")


def transition(store: DataFrame, tier: str) -> DataFrame:
    """The store with every content verified and compressed for another tier."""
    c = read_verified(store)
    moved = c.select("sha256", F.octet_length("content").cast("long").alias("logical_size"), _packed(store.sparkSession, F.col("content"), LEVELS[tier]).alias("blob"))
    return moved.select("sha256", "logical_size", F.octet_length("blob").cast("long").alias("physical_size"), F.lit(tier).alias("tier"), "blob")


def fan_out_path(sha256: Column) -> Column:
    """Where a content lies in a folder tree; null for what is no digest."""
    return F.when(F.rlike(sha256, F.lit("^[0-9a-f]{64}$")), F.concat_ws("/", F.left(sha256, F.lit(2)), F.substring(sha256, 3, 2), sha256))
