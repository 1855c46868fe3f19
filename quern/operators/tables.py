"""Table functions: operators that SQL calls with a row, or with a table that it deals out by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quern.operators.documents import split_text
from quern.session import prepare


class Chunks:
    """(id, chunk_index, content) of a document (id, kind, text)."""

    def eval(self, id: int, kind: str, text: str) -> Iterator[tuple]:
        for k, content in enumerate(split_text(text or "", kind or "")):
            yield id, k, content


class ChunkNumbers:
    """Of a table dealt out by key and ordered: (key, chunks, characters), one row a key, in constant memory."""

    def __init__(self):
        self.key, self.n, self.size = None, 0, 0

    def eval(self, row: Row) -> None:
        self.key, self.n, self.size = row["key"], self.n + 1, self.size + len(row["content"] or "")

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.n, self.size


def registered(spark: SparkSession) -> None:
    """Makes ``chunks`` and ``chunk_numbers`` known to SQL."""
    prepare(spark).udtf.register("chunks", udtf(Chunks, returnType="id bigint, chunk_index int, content string"))
    spark.udtf.register("chunk_numbers", udtf(ChunkNumbers, returnType="key string, chunks bigint, characters bigint"))
