"""What a question or a passage refers to: intent, references, themes, names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions.names import books_claimed, books_of_question
from lectern.functions.text import WORD, keywords, let

REFERENCE = "struct<book_id:string,chapter:int,verse_start:int,verse_end:int>"


def intent(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    name, pattern = lexicon.FALLBACK_INTENT
    out = F.when(c.rlike(f"(?i){pattern}"), name).otherwise("unknown")
    for name, pattern in reversed(lexicon.INTENTS.items()):
        out = F.when(c.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def least_parts(parts: list[str]) -> list[str]:
    """``parts`` less those that hold another one: a text has any of them if it has any of these."""
    return [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]


def themes(c: Column, lexicon_: dict[str, list[str]] | None = None) -> Column:
    """Names of the themes that a substring of the text shows, in the lexicon's order."""
    table = lexicon_ or lexicon.THEMES
    shown = lambda low: F.array(*[F.when(reduce(or_, [low.contains(w) for w in least_parts(words)]), name) for name, words in table.items()])
    return F.filter(let(F.lower(F.coalesce(c, F.lit(""))), shown), lambda x: x.isNotNull())


#: Characters before a reference's colon that are looked at, beyond its name.
BESIDE = 49


def near_colons(c: Column, names: dict[str, str]) -> Column:
    """The text without what is far from every colon: all references in it are found, and no others.

    A reference has one colon, before it a name, blanks and at most nine digits, behind it at most two such numbers. Of a long
    stretch between two colons its two ends stay, a bar between them; where blanks before the colon fill the end, all of it stays.
    """
    longest = max(map(len, names), default=0)
    keep = longest + BESIDE

    def ends(p: Column) -> Column:
        whole = lambda tail: F.length(F.regexp_replace(tail, r"\s*[0-9]*\z", "")) <= longest
        return F.when(F.length(p) <= 2 * keep, p).otherwise(let(F.right(p, F.lit(keep)), lambda tail: F.when(whole(tail), p).otherwise(F.concat(F.left(p, F.lit(keep)), F.lit("|"), tail))))

    if any(":" in n for n in names):
        return F.coalesce(c, F.lit(""))
    return let(F.coalesce(c, F.lit("")), lambda x: F.when(x.contains(":"), F.array_join(F.transform(F.split(x, ":"), ends), ":")).otherwise(""))


def one_of(names: Iterable[str]) -> str:
    """A pattern of the longest of ``names`` that fits. Names share their beginnings, so that a place is compared with a few letters and not with every name."""
    rest: dict[str, list[str]] = {}
    for n in sorted(names):
        rest.setdefault(n[:1], []).append(n[1:])
    ends = rest.pop("", None) is not None
    every = [re.escape(first) + one_of(more) for first, more in rest.items()]
    return every[0] if len(every) == 1 and not ends else f"(?:{'|'.join(every)}){'?' * ends}" if every else ""


def references(c: Column, names: dict[str, str] | None = None) -> Column:
    """``array<struct<book_id, chapter, verse_start, verse_end>>`` of "Book c:v" and "Book c:v-w" in order."""
    table = names or lexicon.NAME_TO_BOOK
    return _full(near_colons(c, table), table)


def _full(near: Column, table: dict[str, str]) -> Column:
    whole = rf"(?i)({one_of(table)})\s+([0-9]{{1,9}}):([0-9]{{1,9}})(?:-([0-9]{{1,9}}))?"
    found = F.regexp_extract_all(near, F.lit(whole), 0)
    code = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    number = lambda m, group: F.expr("try_cast(null as int)") if group is None else F.regexp_extract(m, whole, group)
    return F.transform(
        found,
        lambda m: F.struct(
            code[F.regexp_replace(F.lower(number(m, 1)), r"\s+", " ")].alias("book_id"), number(m, 2).cast("int").alias("chapter"), number(m, 3).cast("int").alias("verse_start"),
            F.nullif(number(m, 4), F.lit("")).cast("int").alias("verse_end"),
        ),
    )


def question_references(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """References by full names, then by aliases at a word's beginning ("Rom5:3"), as a question is read; a full name that is an alias too counts twice."""
    table = aliases or lexicon.ALIAS_TO_BOOK
    whole = rf"(?i)(?<![{WORD}])({one_of(table)})\s*([0-9]{{1,9}}):([0-9]{{1,9}})(?:-([0-9]{{1,9}}))?"
    code = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    part = lambda m, k: F.regexp_extract(m, whole, k)
    ref = lambda m: F.struct(code[F.lower(part(m, 1))].alias("book_id"), part(m, 2).cast("int").alias("chapter"), part(m, 3).cast("int").alias("verse_start"), F.nullif(part(m, 4), F.lit("")).cast("int").alias("verse_end"))
    near = near_colons(c, lexicon.NAME_TO_BOOK | table)
    return let(near, lambda x: F.concat(_full(x, lexicon.NAME_TO_BOOK), F.transform(F.regexp_extract_all(x, F.lit(whole), 0), ref)))


#: No reference with up to twenty blanks is longer: a name of at most 15 characters and three numbers of at most nine digits.
LONGEST = 64


def cut_reference(c: Column, ahead: Column) -> Column:
    """The beginning of ``ahead``, which follows ``c``, that ends a reference begun in ``c``; empty where none runs over the end."""
    names = one_of({*lexicon.NAME_TO_BOOK, *lexicon.ALIAS_TO_BOOK})
    whole = rf"(?i)(?=[\s\S]{{{LONGEST + 2}}}){names}\s*[0-9]{{1,9}}:[0-9]{{1,9}}(?:-[0-9]{{1,9}})?(?=([\s\S]{{1,{LONGEST}}}\z))"
    # blanks fill up what is ahead and one follows, so that what is left behind a match tells where it ends
    seam = lambda a: F.concat(F.right(c, F.lit(LONGEST)), F.rpad(a, LONGEST + 1, "\n"))
    # few seams have a colon, without which no reference runs over them
    left = lambda s: F.when(s.contains(":"), F.length(F.regexp_extract(s, whole, 1)))
    ended = lambda a: let(let(seam(a), left), lambda n: F.when(n > 0, F.substring(a, F.lit(1), LONGEST + 1 - n)).otherwise(""))
    return let(F.substring(F.coalesce(ahead, F.lit("")), 1, LONGEST), ended)


def passage_references(c: Column) -> Column:
    return references(c, {n: b for n, b in lexicon.NAME_TO_BOOK.items() if b not in lexicon.NOT_IN_PASSAGES})


def chapter_references(c: Column, names: dict[str, str] | None = None) -> Column:
    """Distinct references to chapters as ``struct<book_id, chapter, verse_start, verse_end>``: "Romans 8" that no verse follows, "롬 8장", "로마서 8장 28절".

    Verse 0 means the chapter alone. English names are full ones; where a Korean name begins is not looked at.
    """
    table = names or lexicon.NAME_TO_BOOK
    longest = lambda found: "|".join(sorted(found, key=lambda n: (-len(n), n)))
    english = rf"(?i)({longest(table)})\s+([0-9]{{1,3}})(?![:0-9])"
    text = F.coalesce(c, F.lit(""))

    def found(pattern: str, book: dict[str, str]) -> Column:
        code = F.create_map(*[F.lit(x) for pair in book.items() for x in pair])
        part = lambda m, k: F.regexp_extract(m, pattern, k)
        verse = (lambda m: F.lit(None).cast("int")) if book is table else (lambda m: F.nullif(part(m, 3), F.lit("")).cast("int"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(code[F.regexp_replace(F.lower(part(m, 1)), r"\s+", " ")].alias("book_id"), part(m, 2).cast("int").alias("chapter"), F.coalesce(verse(m), F.lit(0)).alias("verse_start"), verse(m).alias("verse_end")))

    # the published alternation takes the first listed name that fits; names before a number and 장 never fit at two lengths
    chapter = r"([0-9]{1,3})\s*장\s*(?:절|[:：])?\s*([0-9]{1,3})?"
    short, full = rf"({longest(lexicon.KOREAN_CHAPTER)})\s*{chapter}", rf"({longest(lexicon.KOREAN_FULL)})\s+{chapter}"
    return F.array_distinct(F.concat(found(english, table), found(short, lexicon.KOREAN_CHAPTER), found(full, lexicon.KOREAN_FULL)))


def asked_references(c: Column) -> Column:
    """A question's references: those with verses, then chapters that none of those is of; of one book, chapter and first verse the first."""
    verses, chapters = question_references(c), chapter_references(c)
    place = lambda r: F.struct(r["book_id"].alias("b"), r["chapter"].alias("c"))
    # a chapter is kept unless a reference before it, with verses or of the same chapter, is of its place
    join = lambda kept, r: F.when(F.array_contains(F.transform(kept, place), place(r)), kept).otherwise(F.array_append(kept, r))
    once = lambda kept, r: F.when(F.exists(kept, lambda x: (x["book_id"] == r["book_id"]) & (x["chapter"] == r["chapter"]) & (x["verse_start"] == r["verse_start"])), kept).otherwise(F.array_append(kept, r))
    return F.aggregate(F.aggregate(chapters, verses, join), F.lit([]).cast(f"array<{REFERENCE}>"), once)


def reference_text(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """"GEN 1:2-3"; verse 0 means the chapter alone."""
    verses = F.when(start > 0, F.concat(F.lit(":"), start.cast("string"), F.when(end.isNotNull(), F.concat(F.lit("-"), end.cast("string"))).otherwise("")))
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.coalesce(verses, F.lit("")))


def names_in(c: Column, names: dict[str, str] | None = None) -> Column:
    """Codes of the books that a text names; see ``books_claimed``."""
    return books_claimed(c, None if names is None else list(names.items()))


def asked_books(c: Column, refs: Column) -> Column:
    """Books that a question asks for: those of its references with verses, those it names, numbered and Korean ones."""
    return F.array_distinct(F.concat(F.transform(refs, lambda r: r["book_id"]), names_in(c), books_of_question(c)))


def parse(c: Column) -> Column:
    """``struct<intent, books, refs, themes, keywords>`` of a question."""
    return F.struct(intent(c).alias("intent"), asked_books(c, question_references(c)).alias("books"), asked_references(c).alias("refs"), themes(c).alias("themes"), keywords(c).alias("keywords"))


# What each sign of good evidence adds.
EVIDENCE = {"in_range": 0.3, "verse": 0.2, "range": 0.1, "repeated": 0.2, "own_book": 0.2}


def evidence(refs: Column, book: Column) -> Column:
    """The reference with the most evidence as ``struct<score, ref>``; the first wins ties, null without any.

    Only the books with known chapter limits can be in range.
    """
    last = F.create_map(*[F.lit(x) for pair in lexicon.CHAPTERS.items() for x in pair])
    part = lambda on, name: F.when(on, EVIDENCE[name]).otherwise(0.0)
    repeated = lambda r: F.size(F.filter(refs, lambda x: (x["book_id"] == r["book_id"]) & (x["chapter"] == r["chapter"]))) > 1
    score = lambda r: part(r["chapter"].between(1, last[r["book_id"]]), "in_range") + part(r["verse_start"] > 0, "verse") + part(r["verse_end"].isNotNull(), "range") + part(repeated(r), "repeated") + part(F.coalesce(r["book_id"] == book, F.lit(False)), "own_book")
    best = F.array_max(F.transform(refs, lambda r, i: F.struct(F.round(score(r), 4).alias("score"), (-i).alias("earlier"), r.alias("ref"))))
    return F.when(F.size(refs) > 0, let(best, lambda b: F.struct(b["score"].alias("score"), b["ref"].alias("ref"))))
