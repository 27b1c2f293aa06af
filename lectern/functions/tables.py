"""Table functions for SQL: chunks, headings and boundaries by the name of a strategy, which users may add to.

``register(spark)`` makes them callable, with the strategies known at that time:

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 'fixed', 1000, 120) c
    SELECT * FROM boundaries(TABLE(SELECT doc_id, kind, at, text FROM lines) PARTITION BY doc_id ORDER BY (kind DESC, at))

Rows come from Arrow batches; a partition of ``boundaries`` is one document, read row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions import chunk

#: Takes (text, size, overlap) and gives chunks.
Chunker = Callable[[str, int, int], list[str]]
#: Takes a text and gives (level, title, place in the text).
Headings = Callable[[str], list[tuple[int, str, int]]]

NUMBERED_LINE = re.compile(r"(?m)^[ \t]*(\d+(?:\.\d+)*)[.)]?[ \t]+(\S.*)$")
ATX = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that overlap by ``overlap``."""
    step = max(1, size - overlap)
    return [text[at : at + size] for at in range(0, max(1, len(text) - overlap), step) if text[at : at + size]]


CHUNKERS: dict[str, Chunker] = {
    "windows": windows,
    "lines": lambda text, size, overlap: [x for x in text.split("\n") if x],
    "paragraph": lambda text, size, overlap: chunk.paragraph_chunks_of(text, size, overlap, 1),
    "recursive": lambda text, size, overlap: chunk.recursive_chunks_of(text, size, overlap, 1),
    "sentence": lambda text, size, overlap: [" ".join(g) for g in chunk.pack_units(chunk.sentences_of(text), size, overlap, " ")],
}
HEADINGS: dict[str, Headings] = {
    "md": lambda text: [(len(m[1]), m[2], m.start()) for m in ATX.finditer(text)],
    "txt": lambda text: [(len(m[1]), m[2], m.start()) for m in ATX.finditer(text)],
    "numbered": lambda text: [(m[1].count(".") + 1, m[2].rstrip(), m.start()) for m in NUMBERED_LINE.finditer(text)],
    "none": lambda text: [],
}


def add_chunker(name: str, chunker: Chunker) -> None:
    CHUNKERS[name] = chunker


def add_headings(name: str, provider: Headings) -> None:
    HEADINGS[name] = provider


def known(table: dict, name: str | None):
    if name not in table:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(sorted(table))}")
    return table[name]


def chunk_function(chunkers: dict[str, Chunker]):
    @F.udtf(returnType="chunk_index int, chunk string", useArrow=True)
    class Chunks:
        """Null or blank text gives no row; an unknown strategy raises."""

        def eval(self, text: str, strategy: str, size: int, overlap: int) -> Iterator[tuple]:
            make = known(chunkers, strategy)
            for k, piece in enumerate(make(text, int(size), int(overlap)) if text and text.strip() else []):
                yield k, piece

    return Chunks


def heading_function(providers: dict[str, Headings]):
    @F.udtf(returnType="heading_index int, level int, title string, place int", useArrow=True)
    class HeadingRows:
        """Headings by the provider of a source type; one without a provider has none."""

        def eval(self, text: str, kind: str) -> Iterator[tuple]:
            provider = providers.get((kind or "").lower(), providers["none"])
            for k, (level, title, place) in enumerate(provider(text) if text else []):
                yield k, level, title, place

    return HeadingRows


def boundary_function(least: int, ahead: int):
    @F.udtf(returnType="doc_id long, at long, met string, score double, is_boundary boolean")
    class Boundaries:
        """Paragraphs (kind ``p``) scored as boundaries; titles (kind ``t``) come before them and are looked for ``ahead`` at a time."""

        def __init__(self) -> None:
            self.titles: list[str] = []
            self.cursor = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            text = row["text"] or ""
            if row["kind"] == "t":
                self.titles.append(text.strip())
                return
            step = next((k for k, t in enumerate(self.titles[self.cursor : self.cursor + ahead]) if t and re.search(rf"(?<!\w){re.escape(t)}(?!\w)", text)), None)
            met = None if step is None else self.titles[self.cursor + step]
            if step is not None:
                self.cursor += step + 1
            score = chunk.boundary_score_of(text, step is not None, least)
            yield row["doc_id"], row["at"], met, float(score), score >= chunk.BOUNDARY_LEAST

    return Boundaries


def register(spark: SparkSession, least: int = chunk.LEAST, ahead: int = 5) -> None:
    """``chunk``, ``headings_of`` and ``boundaries`` as table functions of this session."""
    spark.udtf.register("chunk", chunk_function(dict(CHUNKERS)))
    spark.udtf.register("headings_of", heading_function(dict(HEADINGS)))
    spark.udtf.register("boundaries", boundary_function(least, ahead))
