"""Document plugins: page text and words from files by injected decoders, as a Python data source.

A decoder takes a path and yields rows. Decoders for PDF, images and recognition engines are not part of
this package; they are registered by their users. The one for plain text splits pages at form feeds.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (projection, suffix) -> decoder
DECODERS: dict[tuple[str, str], Callable[[str], Iterator[tuple]]] = {}
SCHEMAS = {
    "pages": "doc_id string, page int, text string",
    "words": "doc_id string, page int, word_id bigint, text string, x0 double, x1 double, top double, bottom double",
}


def decoder(projection: str, suffix: str):
    """Register a decoder for files of a suffix."""

    def add(f: Callable[[str], Iterator[tuple]]) -> Callable[[str], Iterator[tuple]]:
        DECODERS[projection, suffix] = f
        return f

    return add


@decoder("pages", ".txt")
def text_pages(path: str) -> Iterator[tuple]:
    with open(path, encoding="utf-8", errors="replace") as f:
        for i, page in enumerate(f.read().split("\f")):
            yield os.path.basename(path), i + 1, page


@decoder("words", ".txt")
def text_words(path: str) -> Iterator[tuple]:
    """Words at six points a character and twelve a line."""
    n = 0
    for doc, page, text in text_pages(path):
        for row, line in enumerate(text.split("\n")):
            at = 0
            for word in line.split():
                at = line.index(word, at)
                yield doc, page, n, word, at * 6.0, (at + len(word)) * 6.0, row * 12.0, row * 12.0 + 10.0
                at += len(word)
                n += 1


class _File(InputPartition):
    def __init__(self, path: str, decode: Callable[[str], Iterator[tuple]]) -> None:
        self.path, self.decode = path, decode


class _Reader(DataSourceReader):
    def __init__(self, projection: str, folder: str, limit: int | None) -> None:
        self.projection, self.folder, self.limit = projection, folder, limit

    def partitions(self) -> list[InputPartition]:
        """One partition for each file that a decoder knows."""
        found = []
        for top, _, names in sorted(os.walk(self.folder)):
            for name in sorted(names):
                decode = DECODERS.get((self.projection, os.path.splitext(name)[1].lower()))
                if decode:
                    found.append(_File(os.path.join(top, name), decode))
        return found[: self.limit]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from partition.decode(partition.path)


class StatementDocuments(DataSource):
    """Format ``statement_documents``; options: path, projection (pages or words), limit."""

    @classmethod
    def name(cls) -> str:
        return "statement_documents"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("projection", "pages")]

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader(self.options.get("projection", "pages"), self.options["path"], int(limit) if limit else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatementDocuments)
