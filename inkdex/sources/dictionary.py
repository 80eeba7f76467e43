"""Reading stop-token files and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdex.operators.segment import load_entries


def read_stop_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(tok) of a file with one stop token per line, as they stand; empty lines are ignored, repeats count once."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("tok")).where("tok <> ''").distinct()


def stop_list(tokens: DataFrame, column: str = "tok", most: int = 1_000_000) -> list[str]:
    """The distinct non-empty stop tokens on the driver, sorted; more than ``most`` are an error."""
    rows = tokens.select(F.col(column).alias("tok")).where("tok <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} stop tokens")
    return sorted(r.tok for r in rows)


def is_stop_token(token: str, stop: list[str] | set[str]) -> bool:
    """Whether a token is one, by exact characters."""
    return token in stop


def read_dictionary(spark: SparkSession, files: str) -> DataFrame:
    """The entries of comma-separated dictionary files with lines of 'text freq [pos]'; of a repeated text the earlier counts.

    A file ends at its first blank line. Lines with one field, more than three, or a frequency that is no integer are
    left out, as are frequencies below 2. Large files are split among tasks: lines are put in order by file, block and
    place in the block.
    """
    parts = []
    for k, f in enumerate(filter(None, map(str.strip, files.split(",")))):
        at = F.col("_metadata.file_block_start")
        parts.append(spark.read.option("lineSep", "\n").text(f).select(F.lit(k).alias("file_no"), at.alias("block"), F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", "[ \t\r]+", " ")).alias("value")))
    if not parts:
        raise ValueError("no dictionary file is named")
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    ends = lines.where("value = ''").groupBy("file_no").agg(F.min(F.struct("block", "line")).alias("end"))  # one row per file
    lines = lines.join(F.broadcast(ends), "file_no", "left").where(F.col("end").isNull() | (F.struct("block", "line") < F.col("end")))
    f = F.split("value", " ")
    lines = lines.where((F.size(f) >= 2) & (F.size(f) <= 3)).select("file_no", "block", "line", f[0].alias("text"), f[1].try_cast("int").alias("freq"), F.get(f, F.lit(2)).alias("pos"))
    return load_entries(lines, "text", "freq", "pos", "file_no", "block", "line")
