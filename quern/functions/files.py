"""File names, types and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What can be indexed as text.
TEXT_TYPES = ("text/plain", "text/markdown", "text/html", "text/csv", "text/xml", "application/json", "application/xml", "application/javascript", "application/x-python", "application/pdf")
TEXT_EXTENSIONS = (
    ".txt", ".md", ".markdown", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".csv", ".log", ".rst", ".html",
    ".htm", ".pdf", ".jsx", ".tsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".sh", ".bash", ".sql", ".xml",
)
MOST_BYTES = 10 * 1024 * 1024


def extension(name) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def indexable(mime, name, size) -> Column:
    return (F.col(size) <= MOST_BYTES) & (F.col(mime).isin(*TEXT_TYPES) | F.col(mime).startswith("text/") | extension(F.col(name)).isin(*TEXT_EXTENSIONS))


def storage_key(source: Column, digest: Column, name: Column) -> Column:
    """files/{source}/{16 digits of the digest}_{60 characters of the stem}{extension}."""
    ext = extension(name)
    stem = F.regexp_replace(name, r"\.[^./]+$", "")
    return F.concat(F.lit("files/"), source, F.lit("/"), F.substring(digest, 1, 16), F.lit("_"), F.substring(stem, 1, 60), ext)


def key_preview(key: Column) -> Column:
    """First six and last four characters; of keys up to twelve the first three and the last two; nothing of none."""
    ends = lambda a, b: F.concat(F.left(key, F.lit(a)), F.lit("..."), F.right(key, F.lit(b)))
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.length(key) <= 12, ends(3, 2)).otherwise(ends(6, 4))


#: What becomes an image or a text in a message.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
BLOCK_TYPES = ("text/plain", "text/csv", "text/html", "text/markdown", "application/json", "text/xml", "application/xml")
BLOCK_EXTENSIONS = (
    ".txt", ".md", ".csv", ".json", ".xml", ".yaml", ".yml", ".html", ".log", ".ini", ".toml", ".env", ".cfg", ".py", ".js", ".ts", ".jsx", ".tsx", ".java",
    ".c", ".cpp", ".h", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".cs", ".sh", ".bash", ".sql", ".r", ".lua", ".css", ".scss", ".less", ".vue", ".svelte",
)


def block_type(mime: Column, name: Column, text: Column, size: Column) -> Column:
    """image, document, text or binary, by type first and extension then; files over the limit are too large."""
    return (
        F.when(size > MOST_BYTES, "too large").when(mime.isin(*IMAGE_TYPES), "image").when((mime == "application/pdf") | (extension(name) == ".pdf"), "document")
        .when(mime.isin(*BLOCK_TYPES) | extension(name).isin(*BLOCK_EXTENSIONS), "text").when(text.isNotNull(), "text").otherwise("binary")
    )
