"""Readers of files and of structured text, and writers. Paths are Spark's; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import files as FF
from quern.functions import html as H
from quern.functions.text import strip

MOST_BYTES = 50 * 1024 * 1024


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def documents(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, kind, text, error) of the files below a folder whose extension is known, in path order within a partition.

    HTML is stripped; bytes that aren't UTF-8 become replacement characters; files over the limit and kinds without a
    parser here (pdf) come with an error instead of a text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.regexp_replace(FF.extension(F.col("path")), r"^\.", "")
    text = F.decode(F.when(F.col("length") <= most, F.col("content")), "UTF-8")
    typed = raw.where(FF.extension(F.col("path")).isin(*FF.TEXT_EXTENSIONS)).select("path", kind.alias("kind"), "length", text.alias("raw"))
    error = F.when(F.col("length") > most, "too large").when(F.col("kind") == "pdf", "no parser")
    return typed.select("path", "kind", F.when(error.isNull(), F.when(F.col("kind").isin("html", "htm"), H.stripped(F.col("raw"))).otherwise(F.col("raw"))).alias("text"), error.alias("error"))


def log_tail(lines: DataFrame, limit: int = 100, level: str | None = None, search: str | None = None) -> DataFrame:
    """The newest rows of JSON lines (pos, line); lines that aren't JSON are skipped."""
    row = F.from_json("line", "ts string, level string, logger string, message string")
    some = lines.where(F.lower("line").contains(search.lower())) if search else lines
    parsed = some.select("pos", row.alias("r")).where("r.ts IS NOT NULL").select("pos", "r.*")
    if level and level != "all":
        parsed = parsed.where(F.col("level") == level.upper())
    return parsed.orderBy(F.desc("pos")).limit(limit)


def frontmatter(text: Column) -> Column:
    """struct<meta: map, body> of a text with a head of ``key: value`` lines between two lines of dashes."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n?", 1)
    lines = F.filter(F.transform(F.split(head, "\n"), strip), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    entry = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, r"^[^:]*:", "")), r"""^["']+|["']+$""", "").alias("v")))
    has = head != ""
    return F.struct(F.when(has, F.map_from_entries(F.filter(entry, lambda e: e["v"] != ""))).alias("meta"), F.when(has, F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n?", "")).otherwise(text).alias("body"))


def directives(docs: DataFrame) -> DataFrame:
    """(id, pos, directive, target, body) of the headings ``## CHECK|TASK|MESSAGE target``."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=##\s+(?i:CHECK|TASK|MESSAGE)\s)"), lambda p: p.rlike(r"\A##\s+(?i:CHECK|TASK|MESSAGE)\s"))
    head = r"\A##\s+(?i)(CHECK|TASK|MESSAGE)\s+([^\n]+)"
    rows = docs.select("id", F.posexplode(parts).alias("pos", "p"))
    return rows.select("id", "pos", F.lower(F.regexp_extract("p", head, 1)).alias("directive"), strip(F.regexp_extract("p", head, 2)).alias("target"), strip(F.regexp_replace("p", r"\A[^\n]*", "")).alias("body"))


def markdown_lines(memories: DataFrame) -> DataFrame:
    """(id, line): one bullet a memory."""
    return memories.select("id", F.format_string("- **[%s]** %s _(importance: %s)_", F.col("type"), F.col("content"), F.col("importance")).alias("line"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """json, csv, md (a column ``line``) or parquet, one folder of part files."""
    writers = {"json": lambda w: w.json(path), "csv": lambda w: w.option("header", "true").csv(path), "parquet": lambda w: w.parquet(path)}
    if kind == "md":
        df.select("line").write.mode("overwrite").text(path)
    else:
        writers[kind](df.write.mode("overwrite"))


def append(df: DataFrame, path: str, cut: dict[str, int] | None = None) -> None:
    """Appends log rows, with some text columns cut."""
    truncated(df, cut or {}).write.mode("append").parquet(path)


def truncated(df: DataFrame, cut: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in cut.items()})


def snapshots(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str) -> None:
    """A backup: every table below one named folder."""
    if "/" in name or name.startswith("."):
        raise ValueError(f"not a name: {name}")
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")


def restored(spark: SparkSession, root: str, name: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of a backup; names that lead out of its folder are refused."""
    for part in (name, *tables):
        if "/" in part or part.startswith("."):
            raise ValueError(f"not a name: {part}")
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in tables}


def newest(backups: DataFrame, limit: int, most: int = 200) -> DataFrame:
    """Backups (source, name, modified), newest first; a limit below one or over ``most`` is drawn to it."""
    return backups.orderBy(F.desc("modified"), F.desc("name")).limit(clamped(limit, most))


def clamped(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def surplus(backups: DataFrame, keep: int = 5) -> DataFrame:
    """Backups (source, name, modified) beyond the newest ``keep`` of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("modified"), F.desc("name"))
    return backups.withColumn("pos", F.row_number().over(w)).where(F.col("pos") > keep)
