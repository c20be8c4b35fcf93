"""Archives: formats, listings and path safety over tables of archive entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import ARCHIVES_OF_EXTENSIONS, CONTAINER_MAGIC


def _starts(content: Column, magic: bytes, at: int = 1) -> Column:
    return F.substring(content, at, len(magic)) == F.lit(magic)


def extension(path: Column) -> Column:
    """What follows the last dot, null without one."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))


def format_of_content(content: Column) -> Column:
    """Format by magic bytes, null if unknown; tests in a fixed order."""
    first = F.when(F.octet_length(content) < 4, None)
    for name, magic in (("zip", b"PK\x03\x04"), ("zip", b"PK\x05\x06"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!"), ("tar.gz", b"\x1f\x8b"), ("tar.xz", b"\xfd7zXZ\x00"), ("tar.bz2", b"BZ")):
        first = first.when(_starts(content, magic), name)
    first = first.when((F.octet_length(content) >= 263) & _starts(content, b"ustar", 258), "tar")
    return first.when(_starts(content, CONTAINER_MAGIC), "container")


def format_of_path(path: Column) -> Column:
    found = extension(path)
    of = F.create_map(*[F.lit(x) for name, all_of in ARCHIVES_OF_EXTENSIONS.items() for e in all_of.split() for x in (e, name)])
    return F.try_element_at(of, found)


def format_of_file(path: Column, content: Column) -> Column:
    """Magic bytes first, then the extension."""
    return F.coalesce(format_of_content(content), format_of_path(path), F.lit("unknown"))


def format_of_name(name: Column) -> Column:
    """Format by its own name, or by the end of a path, without regard to case."""
    lower = F.lower(name)
    found = F.when(lower.isin("zip", "tar", "7z", "rar", "tar.gz", "tar.bz2", "tar.xz"), lower).when(lower == "tgz", "tar.gz").when(lower.isin("cute", "container"), "container")
    for end, format_name in ((".tar.gz", "tar.gz"), (".tgz", "tar.gz"), (".tar.bz2", "tar.bz2"), (".tbz2", "tar.bz2"), (".tar.xz", "tar.xz"), (".txz", "tar.xz"), (".cute", "container"), *[(f".{x}", x) for x in ("zip", "tar", "7z", "rar")]):
        found = found.when(lower.endswith(end), format_name)
    return F.coalesce(found, F.lit("unknown"))


def to_dos(at: Column) -> list[Column]:
    """dos_date, dos_time of a timestamp in the session's time zone, to two seconds; what is before 1980 is its first day."""
    early = F.year(at) < 1980
    date = (F.year(at) - 1980) * 512 + F.month(at) * 32 + F.dayofmonth(at)
    time = F.hour(at) * 2048 + F.minute(at) * 32 + F.floor(F.second(at) / 2)
    return [F.when(early, 33).otherwise(date).cast("int").alias("dos_date"), F.when(early, 0).otherwise(time).cast("int").alias("dos_time")]


def from_dos(date: Column, time: Column) -> Column:
    """Timestamp in the session's time zone."""
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    return F.make_timestamp(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2)


def entry_at(entries: DataFrame, idx: int) -> DataFrame:
    """The entry of a place in each archive's directory."""
    return entries.where(F.col("idx") == idx)


def convert(spark, source: str, target: str, format_name: str) -> None:
    """Writes the entries of an archive, or of a folder of archives, as archives of another format."""
    entries = spark.read.format("archive").load(source).where("not symlink and not encrypted")
    entries.write.format("archive").option("format", format_name).mode("append").save(target)


def extract_to(entries: DataFrame, target: str) -> None:
    """Writes the contents of safe entries as files below a folder, with their mode bits."""
    safe(entries).where("not is_dir and content is not null").select("path", "content", "permissions").write.format("files").mode("append").save(target)


def find(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path).orderBy("archive", "idx").limit(1)


def children(entries: DataFrame, prefix: str) -> DataFrame:
    """Direct children of a directory prefix, which is taken literally: what follows it is not empty and has no slash but a last one."""
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    slash = F.instr(rest, "/")
    return entries.where(F.col("path").startswith(prefix)).where((rest != "") & ((slash == 0) | (slash == F.length(rest))))


def safe(entries: DataFrame) -> DataFrame:
    """Entries that may be extracted: paths with .. are refused."""
    return entries.where(~F.contains("path", F.lit("..")))


def extraction_report(entries: DataFrame) -> DataFrame:
    """archive, entries, refused, failed: failed counts encrypted entries and contents whose CRC-32 differs from the directory's."""
    refused = F.contains("path", F.lit(".."))
    broken = F.col("encrypted") | (F.col("content").isNotNull() & F.col("crc32").isNotNull() & (F.crc32("content") != F.col("crc32")))
    return entries.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if(refused).alias("refused"), F.count_if(~refused & F.coalesce(broken, F.lit(False))).alias("failed"))
