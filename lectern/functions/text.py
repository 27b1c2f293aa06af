"""Text cleanup, tokens and identity as column expressions.

Character classes are spelled out, so that they mean the same in every regexp
dialect: a word character is a letter, number or underscore of any script, and
blanks are all Unicode white space. Null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern import lexicon

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
#: The same blanks one by one, for functions that take characters and no pattern.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c).startswith("Z"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(c: Column, places: int) -> Column:
    """``c`` rounded as binary engines do: scaled, then half away from zero. ``round`` looks at the decimal digits instead, which fall on the other side of some halves."""
    return F.round(c * 10.0**places) / 10.0**places


def count_chars(c: Column, chars: str) -> Column:
    """How many characters are in a class (what stands between the brackets); no list of matches is made."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def holds(c: Column, parts) -> Column:
    """Whether the text has any of ``parts``, compared byte by byte; far cheaper than a pattern that finds nothing."""
    return reduce(or_, [c.contains(x) for x in parts])


def replace_where(c: Column, parts, pattern: str, by: str) -> Column:
    """``regexp_replace`` of texts that have any of ``parts``, without which ``pattern`` cannot match."""
    return let(c, lambda x: F.when(holds(x, parts), F.regexp_replace(x, pattern, by)).otherwise(x))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalise_basic(c: Column) -> Column:
    """Line ends to LF, tabs and runs of blanks to one blank, at most one empty line, stripped; null is empty."""
    ends = lambda x: F.when(holds(x, "\r\t"), F.translate(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\r\t", "\n ")).otherwise(x)
    c = replace_where(let(F.coalesce(c, F.lit("")), ends), ["  ", "\xa0"], r"[ \x{00A0}]+", " ")
    return strip(replace_where(c, ["\n\n\n"], r"\n{3,}", "\n\n"))


def normalise_extracted(c: Column) -> Column:
    """``normalise_basic`` for extracted text: also joins words hyphenated over a line break."""
    c = F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    c = F.regexp_replace(c, r"([A-Za-z가-힣0-9])-[ \t]*\n[ \t]*([A-Za-z가-힣0-9])", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{00A0}]+", " "), r"\n{3,}", "\n\n"))


# Blanks that recognition put inside words, as in "T he", "t he" and "wo rd s"; a pattern begins with what is rare and looks back from there
SPLIT_CAPITAL = rf"([A-Z]) (?<![{WORD}][A-Z] )([a-z]{{2,}}+)(?![{WORD}])"
SPLIT_LETTER = rf"([b-hj-z]) (?<![{WORD}][b-hj-z] )([a-z]{{1,2}})(?![{WORD}])"
SPLIT_PART = r" (?<=[a-z] )([a-z]{1,3}+)(?= [a-z])"


def repair_word_splits(c: Column) -> Column:
    """Blanks that recognition put inside words: "T he" -> "The".

    The last pass needs no repetition: a blank that fits after others have gone had the same letters on both sides before, so it went with them.
    """
    for pattern in (SPLIT_CAPITAL, SPLIT_LETTER):
        c = F.regexp_replace(c, pattern, "$1$2")
    return F.regexp_replace(c, SPLIT_PART, "$1")


def _page_marks(c: Column) -> Column:
    """``c``, which is normalised, without page-number lines, with hyphenated words joined."""
    c = F.regexp_replace(c, r"(?m)^[ \t]*[0-9]+[ \t]*$", "")
    c = F.regexp_replace(c, r"(?mi)^[ \t]*page\s+[0-9]+[ \t]*$", "")
    return replace_where(c, ["-\n"], rf"([{WORD}])-\n([{WORD}])", "$1$2")


def _recognised(c: Column) -> Column:
    """What recognition leaves behind: split words, rows of bars, accents and marks."""
    c = replace_where(replace_where(repair_word_splits(c), "|¦", "[|¦]{2,}", " "), "~`^", "[~`^]{2,}", " ")
    return replace_where(F.regexp_replace(c, rf"(?m)^[^{WORD}]{{3,}}$", ""), "·•※◆▶→←↑↓", "[·•※◆▶→←↑↓]{2,}", " ")


def _closed(c: Column) -> Column:
    return strip(replace_where(c, ["\n\n\n"], r"\n{3,}", "\n\n"))


def clean_paged(c: Column, recognised: bool = False) -> Column:
    """Paged text without page-number lines, with hyphenated words joined; more for recognised scans."""
    c = _page_marks(normalise_basic(c))
    return _closed(_recognised(c) if recognised else c)


def both_cleaned(basic: Column) -> Column:
    """``struct<paged, scan>`` of a normalised text: ``clean_paged`` without and with what is done for scans, their common part once."""
    return let(_page_marks(basic), lambda c: F.struct(_closed(c).alias("paged"), _closed(_recognised(c)).alias("scan")))


# Korean particles that a line break may have cut off.
PARTICLES = "이|가|을|를|은|는|의|에서|에게|에|으로|로|와|과|도|만|까지|보다|처럼|부터|한테|께|서|고|며|면|야|랑|이랑|란|이란|만큼|대로|같이|님|적"


def postprocess_paged(c: Column) -> Column:
    """Extracted pages without glyph leftovers, with hyphenated words, soft breaks, split words and Korean particles joined; page breaks stay."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFF}]|[\x00-\x08\x0B\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"[\x{A0}\x{AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]", " ")
    c = F.regexp_replace(c, rf"(?m)^[{WS}]*(?:[lIifl·•※◆▶→←↑↓]|ff|fi|fl)[{WS}]*$", "")
    c = F.regexp_replace(c, r"([A-Za-z])-\n([a-z])", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, r"([.!?])\n([A-Z가-힣])", "$1\n\n$2"), r"([a-zA-Z])\n([a-zA-Z])", "$1 $2")
    c = repair_word_splits(c)
    for _ in range(5):
        c = F.regexp_replace(c, rf"([가-힣])\n({PARTICLES})(?=[가-힣{WS}.,!?;:\n]|$)", "$1$2")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Canonically composed text; only what is beyond Latin-1 is handed to Python, other rows as nulls."""
    beyond = c.rlike(r"[^\x00-\xFF]")
    return F.coalesce(_composed(F.when(beyond, c)), c)


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Text with compatible characters made equal (full-width letters, ligatures, superscripts) and composed; only what is beyond ASCII is handed to Python."""
    return F.coalesce(_compatible(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalise_identity(c: Column) -> Column:
    c = F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(normalise_identity(c).cast("binary"), 256)


def document_id(c: Column, source: Column) -> Column:
    """32 digits of the content hash; a document without content is named after its source."""
    return F.when(normalise_identity(c) == "", F.concat(F.lit("empty_"), source)).otherwise(F.substring(content_hash(c), 1, 32))


def chunk_id(document: Column, index: Column) -> Column:
    return F.concat(document, F.lit("_chunk_"), F.lpad(index.cast("string"), 5, "0"))


def short_hash(c: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, digits)


def tokens(c: Column) -> Column:
    """Lower-cased words; punctuation is deleted, not replaced ("well-known" is one token)."""
    # one pass makes every blank the same and drops punctuation, so that the split needs no pattern
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), BLANKS + string.punctuation, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def words(c: Column) -> Column:
    """Lower-cased runs of at least three ASCII letters that stand alone."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{WORD}]+"), 0), lambda w: w.rlike("^[a-z]{3,}$"))


def keywords(c: Column, most: int = 20) -> Column:
    """The first ``most`` distinct words of a question that are no stop words."""
    return F.slice(F.array_distinct(F.array_except(words(c), F.array(*map(F.lit, lexicon.STOP_WORDS)))), 1, most)


def lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    rare = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    every = lambda x: F.split(x, F.when(holds(x, rare), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]").otherwise("\n"))
    return F.filter(F.transform(let(F.coalesce(c, F.lit("")), every), strip), lambda x: x != "")


def headings(c: Column) -> Column:
    """``array<struct<level, title>>`` of the text's number-sign headings."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,6}[ \t]+.+?[ \t]*#*[ \t]*)$"), 1)
    level = lambda h: F.length(F.regexp_extract(h, "^(#+)", 1))
    return F.transform(found, lambda h: F.struct(level(h).alias("level"), F.regexp_replace(h, r"^#{1,6}[ \t]+|[ \t]*#*[ \t]*$", "").alias("title")))


def sections(c: Column) -> Column:
    """The text cut before each heading of level 1 to 3; empty sections go."""
    return F.filter(F.transform(F.split(c, r"(?m)(?=^#{1,3}[ \t])"), strip), lambda x: x != "")


def front_matter(c: Column) -> Column:
    """``map<string,string>`` of a leading block between lines of three hyphens; empty without one."""
    block = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    # a key that occurs twice keeps its last value
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


PAGE = "\f"
MAX_FRONT_PAGES = 15
# Words that make a page front matter.
FRONT_WORDS = rf"(?im)(Copyright|ISBN|All rights reserved|Table of Contents|판권|발행처|발행인|(?<![{WORD}])인쇄(?![{WORD}])|옮김|저작권|목차|초판|재판\s*발행|Abbreviations|Acknowledge?ments?|Preface|Glossary|약어표?|서문|감사의\s*글|색인|\AIndex\s*\z)"


def split_front_pages(c: Column) -> Column:
    """``struct<front, body>``: pages among the first that look like front matter, and the others."""
    whole = F.struct(F.lit("").alias("front"), F.coalesce(c, F.lit("")).alias("body"))

    def is_front(p: Column) -> Column:
        short = lambda every: F.size(F.filter(every, lambda x: F.length(x) <= 3)) / F.greatest(F.size(every), F.lit(1))
        return (p == "") | p.rlike(FRONT_WORDS) | ((F.length(p) < 400) & (let(lines(p), short) > 0.3))

    def parts(marked: Column) -> Column:
        # where every page looks like front matter only the first counts
        alone = F.forall(marked, lambda z: z["f"])
        part = lambda front: F.array_join(F.transform(F.filter(marked, lambda z, i: (z["f"] & (~alone | (i == 0)) == front) & (z["p"] != "")), lambda z: z["p"]), "\n\n")
        return F.struct(part(F.lit(True)).alias("front"), part(F.lit(False)).alias("body"))

    # each page is stripped and judged once, only those that may be front matter are judged
    page = lambda p, i: F.struct(p.alias("p"), F.when(i < MAX_FRONT_PAGES, is_front(p)).otherwise(False).alias("f"))
    return F.when(c.contains(PAGE), let(F.transform(F.transform(F.split(c, PAGE), strip), page), parts)).otherwise(whole)


def safe_stem(c: Column) -> Column:
    """A file name's stem with what is no word character, hyphen or dot as one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), rf"[^{WORD}.\-]+", "_")


def size_text(n: Column) -> Column:
    """A byte count for people: B, KB, MB, GB."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.1f GB", n / 1024**3))
    )


def strip_tags(c: Column) -> Column:
    """Visible text of a web page: scripts, styles and head go, every other tag breaks the line."""
    for tag in ("script", "style", "noscript", "head"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(c, "(?s)<[^>]*>", "\n")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")
