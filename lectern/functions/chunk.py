"""Chunking strategies.

Windows and headings are column expressions; paragraph packing is an ordered fold
over a document's text and runs in Arrow batches, one row at a time in memory.
Null text gives an empty array everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern import lexicon
from lectern.functions.quality import BOUNDARY_LEAST, BOUNDARY_WEIGHTS
from lectern.functions.text import WS, let, strip

SIZE, OVERLAP, LEAST = 1200, 120, 80

# What ends a sentence or a line in Korean and English prose.
KOREAN = re.compile("[가-힣]")
SENTENCE_MARK = re.compile("[.!?。！？]")
KOREAN_END = re.compile("(?:다|니다|요|이다|했다|하였다|됩니다|입니다|같다|라고|하며|하면|하지만|그래서|그러나)$")
KOREAN_FULL_END = re.compile(r"(?:다|이다|니다|요|였다|합니다|입니다|했다|하였다|됩니다|같다|라고|하며|하면|하지만|그래서|그러나)$|(?:다|요)\.$")
BULLET = re.compile(r"\s*(?:[-•*]|\d+[.)])\s+")
HYPHEN_BREAK = re.compile(r"([A-Za-z가-힣0-9])-[ \t]*\n[ \t]*([A-Za-z가-힣0-9])")
LATIN, ORIGINAL = re.compile("[A-Za-z]"), re.compile("[֐-׿Ͱ-Ͽἀ-῿]")


def fixed_windows(c: Column, size: int = 1000, overlap: int = 100, least: int = 50) -> Column:
    """Windows of ``size`` characters, cut back to the last blank beyond their middle unless they reach the end."""

    def windows(c: Column) -> Column:
        starts = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))

        def window(start: Column) -> Column:
            piece = F.substring(c, start, F.lit(size))
            blank = F.length(piece) - F.instr(F.reverse(piece), " ")  # its place from 0, or the length if there is none
            cut = (start + size - 1 < F.length(c)) & (F.instr(piece, " ") > 0) & (blank > size * 0.5)
            return strip(F.when(cut, F.substring(piece, F.lit(1), blank)).otherwise(piece))

        return F.filter(F.transform(starts, window), lambda x: F.length(x) >= least)

    return let(F.coalesce(c, F.lit("")), windows)  # a text that is itself worked out is not worked out again for each window


def structure_chunks(c: Column, size: int = 1000, overlap: int = 100, least: int = 50) -> Column:
    """Text from each heading or numbered line to the next; windows where there is at most one."""
    head = r"(?m)^(#{1,3}[ \t]+[^\n]+|[0-9]+[.)][ \t]+[^\n]+)$"

    def chunks(c: Column) -> Column:
        parts = F.filter(F.split(c, r"(?m)(?=^(?:#{1,3}[ \t]+[^\n]|[0-9]+[.)][ \t]+[^\n]))"), lambda x: x.rlike(head))
        long = F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least)
        return F.when(F.regexp_count(c, F.lit(head)) <= 1, fixed_windows(c, size, overlap, least)).otherwise(long)

    return let(F.coalesce(c, F.lit("")), chunks)


def sentence_chunks(c: Column, size: int = 1000, least: int = 50) -> Column:
    """Sentences packed up to ``size`` characters, joined by an empty line, without overlap."""
    c = F.coalesce(c, F.lit(""))
    sentences = F.filter(F.transform(F.split(c, rf"(?<=[.!?])[{WS}]+"), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        full = (a["n"] > 0) & (a["n"] + F.length(s) > size)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full | (a["n"] == 0), s).otherwise(F.concat(a["open"], F.lit("\n\n"), s)).alias("open"),
            F.when(full, F.length(s)).otherwise(a["n"] + F.length(s)).alias("n"),
        )

    return F.filter(F.aggregate(sentences, start, step, lambda a: F.concat(a["done"], F.array(a["open"]))), lambda x: F.length(strip(x)) >= least)


def paragraphs_of(text: str | None) -> list[str]:
    """Paragraphs with soft line breaks joined; Korean lines break where a sentence ends."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub(r"[ \t\xa0]+", " ", HYPHEN_BREAK.sub(r"\1\2", text)).strip()
    ends = lambda s: bool(SENTENCE_MARK.search(s) or KOREAN_END.search(s))
    done, last = [], ""
    for line in map(str.strip, text.split("\n")):
        both = KOREAN.search(last) and KOREAN.search(line)
        breaks = both and ends(last) and (len(line) >= 20 or ends(line))
        if line and last and not breaks:
            done[-1] += " " + line
        elif line:
            done.append(line)
        last = line
    return done


def _language(s: str) -> str:
    korean, latin = len(KOREAN.findall(s)), len(LATIN.findall(s))
    if not korean and not latin:
        return "mixed" if len(ORIGINAL.findall(s)) >= 3 else "other"
    if len(s) < 40 and korean and latin:
        return "mixed"
    share = korean / (korean + latin)
    return "ko" if share >= 0.8 else "en" if share <= 0.2 else "mixed"


def sentences_of(text: str | None) -> list[str]:
    """Paragraphs merged until one ends like a sentence of its language; bullets stand alone."""
    full_korean = lambda s: bool(KOREAN_FULL_END.search(s))
    full_english = lambda s: s[-1:] in (".", "!", "?")
    out: list[str] = []
    last = ""
    for line in paragraphs_of(text):
        short, ended = len(line) < 24, full_korean(last) or full_english(last)
        kinds = {_language(last), _language(line)} if last else set()
        if BULLET.match(line) or not last:
            joins = False
        elif kinds in ({"ko"}, {"en"}):
            full = full_korean if kinds == {"ko"} else full_english
            joins = not full(last) or (short and not full(line))
        elif "mixed" in kinds:
            joins = short or not ended
        else:
            joins = not ended or (short and not SENTENCE_MARK.search(line))
        if joins:
            out[-1] += " " + line
        else:
            out.append(line)
        last = "" if BULLET.match(line) else line
    return out


def hard_slices(s: str, size: int, marks: bool = True) -> list[str]:
    """Pieces of at most ``size`` characters cut between words (and at verse marks); only a longer word is cut itself."""
    pieces, held = [], ""
    for token in re.split("(\\s+|׃)" if marks else "(\\s+)", s):
        if len(held) + len(token) <= size:
            held += token
            continue
        pieces.append(held)
        held = token
        if len(token) > size:
            pieces += [token[k : k + size] for k in range(0, len(token), size)]
            held = ""
    return [p.strip() for p in [*pieces, held] if p.strip()]


def word_tail(s: str, most: int) -> str:
    """The longest end of ``s`` of at most ``most`` characters that begins at a word."""
    if most <= 0 or len(s) <= most:
        return s.strip() if most > 0 else ""
    at = re.search("[\\s׃]", s[-most:])
    return s[-most:][at.start() :].strip() if at else ""


def pack_units(units: list[str], size: int, overlap: int, joiner: str) -> Iterator[list[str]]:
    """Consecutive units that fit together; each group but the first begins with the end of the one before."""
    held: list[str] = []
    for unit in units:
        if held and len(joiner.join([*held, unit])) > size:
            yield held
            tail: list[str] = []
            for u in reversed(held[1:] if overlap > 0 else []):
                tail.insert(0, u)
                if sum(len(t) + len(joiner) for t in tail) >= overlap:
                    break
            if sum(len(t) + len(joiner) for t in tail) > 2 * overlap:
                tail = [t for t in (word_tail(tail[0], overlap),) if t] + tail[1:]
            held = tail
        held = [*held, unit]
    if held:
        yield held


def paragraph_chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Paragraphs packed to ``size``; overlong ones, and those in several scripts, go by sentences."""
    chunks: list[str] = []
    together: list[str] = []

    def close() -> None:
        chunks.extend(c for c in ("\n\n".join(g).strip() for g in pack_units(together, size, overlap, "\n\n")) if len(c) >= least)
        together.clear()

    for p in paragraphs_of(text):
        by_sentence = _language(p) == "mixed" or len(ORIGINAL.findall(p)) >= 3
        if not by_sentence and len(p) <= int(size * 1.5):
            together.append(p)
            continue
        close()
        if by_sentence:
            before = ""
            for s in sentences_of(p):
                with_context = f"{word_tail(before, overlap)} {s}".strip()
                chunks += [with_context if len(with_context) <= size else s] if len(s) <= size else hard_slices(s, size)
                before = s
        else:
            pieces = [x for s in sentences_of(p) for x in (hard_slices(s, size) if len(s) > size else [s])]
            if len(pieces) > 1 and len(pieces[-1]) < least:
                pieces[-2:] = [" ".join(pieces[-2:])]
            chunks += pieces
    close()
    return chunks


def candidates_of(text: str | None) -> list[tuple[str, int]]:
    """Paragraphs with their offsets in the normalised text (paragraphs joined by an empty line)."""
    out, at = [], 0
    for p in paragraphs_of(text):
        out.append((p, at))
        at += len(p) + 2
    return out


REFERENCE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(lexicon.ALIAS_TO_BOOK, key=lambda n: (-len(n), n)))})\s*\d+:\d+", re.I)


def boundary_score_of(text: str, heading: bool, least: int) -> float:
    """The same sum of features as the column expression, for one paragraph."""
    plain = text.strip()
    last = next((x.strip() for x in reversed(plain.splitlines()) if x.strip()), "")
    on = {"heading": heading, "paragraph": bool(plain), "tiny": len(plain) < least, "sentence_end": bool(SENTENCE_MARK.search(last) or KOREAN_END.search(last)), "reference": bool(REFERENCE.search(plain[:50]))}
    return sum(BOUNDARY_WEIGHTS[name] for name, true in on.items() if true)


def boundaries_of(paragraphs: list[tuple[str, int]], titles: list[str], contained: Callable, least: int = LEAST, ahead: int = 5) -> list[bool]:
    """Which paragraphs begin a new part; a heading is looked for among the next ``ahead`` titles that have not been met."""
    cursor, out = 0, []
    for text, _ in paragraphs:
        step = contained(titles[cursor : cursor + ahead], text)
        if step is not None:
            cursor += step + 1
        out.append(boundary_score_of(text, step is not None, least) >= BOUNDARY_LEAST)
    return out


def hierarchical_chunks_of(paragraphs: list[tuple[str, int]], starts: list[bool], size: int = SIZE, least: int = LEAST) -> list[tuple[str, int]]:
    """Paragraphs gathered until a boundary (after ``least`` characters) or the cap of one and a half sizes; overlong ones are sliced between words."""
    cap, out, held, n = int(size * 1.5), [], [], 0

    def close() -> None:
        nonlocal held, n
        if held:
            out.append(("\n\n".join(p for p, _ in held).strip(), held[0][1]))
        held, n = [], 0

    for (text, at), starts_part in zip(paragraphs, starts):
        if starts_part and n >= least or len(text) > cap:
            close()
        if len(text) > cap:
            cursor = 0
            for piece in hard_slices(text, size, marks=False):
                cursor = text.index(piece, cursor)
                out.append((piece, at + cursor))
                cursor += len(piece)
            continue
        held.append((text, at))
        n += len(text) + 2
        if n > cap:
            close()
    close()
    return out


def offsets_in(text: str, pieces: list[str], probe: int = 40, back: int = 50) -> list[int]:
    """Where each piece begins in ``text``, looked for from a little before the last one on, else from the beginning; pieces not found have none."""
    out, cursor = [], 0
    for piece in pieces:
        head = piece[:probe]
        at = text.find(head, max(0, cursor - back)) if head else -1
        at = text.find(head) if head and at < 0 else at
        if at >= 0:
            out.append(at)
            cursor = at
    return out


def reflow_of(text: str | None) -> str | None:
    """A text for reading: each block of lines as one sentence a line."""
    if not text or not text.strip():
        return text
    blocks = [b for b in re.split(r"\n[ \t]*\n", text) if b.strip()]
    return "\n\n".join("\n".join(sentences_of(b)) or b.strip() for b in blocks)


# Where text is split, from the coarsest to single characters.
SEPARATORS = ("\n\n", "\n", "다. ", "요. ", ". ", "! ", "? ", "\u05c3 ", "\u05c3", " ", "")


def recursive_chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: split at the coarsest separator that occurs, finer where a part is too long, small parts merged with ``overlap``."""

    def split(value: str, finer: tuple[str, ...]) -> Iterator[str]:
        at = next((k for k, x in enumerate(finer) if not x or x in value), len(finer) - 1)
        mark, rest = finer[at], finer[at + 1 :]
        # a separator stays at the beginning of what follows it
        parts = list(value) if not mark else [p for k, x in enumerate(value.split(mark)) for p in ([mark + x] if k else [x]) if p]
        together: list[str] = []
        for part in parts:
            if len(part) < size:
                together.append(part)
                continue
            yield from merge(together)
            together = []
            if rest:
                yield from split(part, rest)
            else:
                yield part
        yield from merge(together)

    def merge(parts: list[str]) -> Iterator[str]:
        held, n = [], 0
        for part in parts:
            if held and n + len(part) > size:
                yield "".join(held).strip()
                while n > overlap or held and n + len(part) > size:
                    n -= len(held.pop(0))
            held.append(part)
            n += len(part)
        if held:
            yield "".join(held).strip()

    return [c for c in split(text or "", separators) if len(c) >= least]


def token_batches(lengths: list[int], most: int = 1600) -> list[int]:
    """The batch of each text for a service that takes ``most`` estimated tokens (half the characters, one at least) at a time."""
    out, batch, held = [], 0, 0
    for n in (max(1, x // 2) for x in lengths):
        if held and held + n > most:
            batch, held = batch + 1, 0
        out.append(batch)
        held += n
    return out


#: Characters of text that a task has as Python strings at once, but for a single longer text.
CHARACTERS = 1 << 20


def chunks_in_rows(batches: Iterator[pa.RecordBatch], chunks_of: Callable = paragraph_chunks_of) -> Iterator[pa.RecordBatch]:
    """``key, chunk_index, chunk`` of batches (key, text), handed on as soon as there are ``CHARACTERS`` of them, whatever a batch holds."""
    for batch in batches:
        held, n = ([], [], []), 0
        for key, text in zip(batch.column(0), batch.column(1)):
            found = chunks_of(text.as_py())
            for column, values in zip(held, ([key] * len(found), range(len(found)), found)):
                column.extend(values)
            n += sum(map(len, found))
            if n >= CHARACTERS:
                yield _chunk_rows(held, batch.schema)
                held, n = ([], [], []), 0
        yield _chunk_rows(held, batch.schema)


def _chunk_rows(held: tuple[list, list, list], schema: pa.Schema) -> pa.RecordBatch:
    key = schema.field(0)
    return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in held[0]], key.type), pa.array(held[1], pa.int32()), pa.array(held[2], pa.string())], [key.name, "chunk_index", "chunk"])


def paragraph_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, chunk_index, chunk) for each of ``paragraph_chunks``, without an array of all of a text's chunks."""
    return docs.select(key, text).mapInArrow(chunks_in_rows, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, chunk string")


@F.pandas_udf(ArrayType(StringType()))
def paragraph_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(paragraph_chunks_of)


@F.pandas_udf(ArrayType(StringType()))
def paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(paragraphs_of)


@F.pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(sentences_of)


@F.pandas_udf(StringType())
def reflow(texts: pd.Series) -> pd.Series:
    return texts.map(reflow_of)


def recursive_chunks(size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Callable[[Column], Column]:
    return F.pandas_udf(lambda texts: texts.map(lambda t: recursive_chunks_of(t, size, overlap, least)), ArrayType(StringType()), F.PandasUDFType.SCALAR)


# Size and overlap by source type, and the named strategies of comparisons.
PRESETS = {
    "pdf": (900, 120), "txt": (1000, 120), "md": (1200, 150), "docx": (1000, 120), "epub": (1000, 120), "html": (1000, 120), "htm": (1000, 120), "rtf": (1000, 100), "default": (1200, 200),
}
STRATEGIES = {"fixed_500": ("fixed", 500, 60), "fixed_1000": ("fixed", 1000, 120), "fixed_1500": ("fixed", 1500, 180), "semantic_1000": ("semantic", 1000, 120), "structure_based": ("structure", 1000, 120)}


def chunks_by(strategy: str, c: Column, size: int = 1000, overlap: int = 120) -> Column:
    """Chunks by the kind of strategy: fixed, semantic or structure; any other counts as fixed."""
    if strategy == "semantic":
        return sentence_chunks(c, size)
    return structure_chunks(c, size, overlap) if strategy == "structure" else fixed_windows(c, size, overlap)


def broken_sentence_ratio(sentences_column: Column) -> Column:
    """Share of sentences, but for the last, that end in a letter or digit without a full ending."""
    n = F.size(sentences_column)
    cut = F.size(F.filter(F.slice(sentences_column, 1, F.greatest(n - 1, F.lit(0))), lambda s: s.rlike("[A-Za-z가-힣0-9]$") & ~s.rlike(KOREAN_FULL_END.pattern)))
    return F.when(n < 2, 0.0).otherwise(cut / F.greatest(n, F.lit(1)))
