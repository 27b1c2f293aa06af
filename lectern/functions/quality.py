"""Language by script, noise scores, noise classes: column expressions only.

Every ratio of an empty text is 0; an empty text has noise 100.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPLIT_CAPITAL, SPLIT_LETTER, SPLIT_PART, WORD, WS, both_cleaned, clean_paged, count_chars, let, lines, normalise_basic, rounded, strip

SYMBOLS = rf"^{WORD}{WS}"
SYMBOL = f"[{SYMBOLS}]"
SCALE, FLOOR = 14, 3.0
# Scripts in the order in which they are tried, as character classes.
SCRIPTS = {"ko": "가-힣ᄀ-ᇿ", "ja": "぀-ヿ", "zh": "一-鿿", "he": "֐-׿", "el": "Ͱ-Ͽ"}
# Policy, quality score and section of each noise type.
NOISE_TYPES = {
    "PAGE_NUMBER": ("REMOVE", 0.0, "boilerplate"),
    "HEADER_FOOTER": ("REMOVE", 0.0, "boilerplate"),
    "BIBLIOGRAPHY": ("DOWNWEIGHT", 0.3, "bibliography"),
    "ABBREVIATION": ("DOWNWEIGHT", 0.3, "abbreviation"),
    "OCR_FRAGMENT": ("DOWNWEIGHT", 0.3, "ocr_fragment"),
    "ORIGINAL_LANGUAGE": ("PRESERVE", 1.0, "original_language_note"),
    "NORMAL_CONTENT": ("NORMAL", 1.0, "body"),
}


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def script_language(c: Column, least: float = 0.1) -> Column:
    """The first script with over a tenth of the characters that are not blank, else en."""

    def name(c: Column) -> Column:
        total, out = count_chars(c, f"^{WS}"), F.lit("en")
        for language, chars in reversed(SCRIPTS.items()):
            out = F.when(share(count_chars(c, chars), total) > least, language).otherwise(out)
        # most texts have no character of any of the scripts
        return F.when(c.rlike(f"[{''.join(SCRIPTS.values())}]"), out).otherwise("en")

    return let(F.coalesce(c, F.lit("")), name)


def symbol_ratio(c: Column) -> Column:
    # all that is no symbol goes in long runs; most of it is plain, which a table tells before classes are looked up one after the other
    symbols = F.regexp_replace(c, f"[[{string.ascii_letters}{string.digits} \n][{WORD}{WS}]]+", "")
    return share(F.length(symbols), F.length(c))


def short_share(every: Column) -> Column:
    return share(F.size(F.filter(every, lambda x: F.length(x) <= 3)), F.size(every))


def short_line_ratio(c: Column) -> Column:
    return let(lines(c), short_share)


def repeated_mark_ratio(c: Column) -> Column:
    return share(count(c, rf"({SYMBOL})\1{{2,}}"), F.length(c))


def odd_character_ratio(c: Column) -> Column:
    return share(count_chars(c, rf"""^{WORD}{WS}.,;:!?()"'\\\-"""), F.length(c))


def word_split_ratio(c: Column) -> Column:
    hits = sum(count(c, p) for p in (SPLIT_CAPITAL, SPLIT_LETTER, SPLIT_PART))
    return hits / F.greatest(F.length(c) / 100.0, F.lit(1.0))


def artifact_share(every: Column) -> Column:
    odd = lambda x: x.rlike(r"^(?:\p{Nd}+|(?i:page)\s+\p{Nd}+|[-–—_]{1,4})$")
    return share(F.size(F.filter(every, odd)), F.size(every))


def page_artifact_ratio(c: Column) -> Column:
    return let(lines(c), artifact_share)


def broken_ratio(c: Column) -> Column:
    """Share of lines, but for the last, that end in a letter or digit: sentences cut off."""

    def ratio(every: Column) -> Column:
        broken = F.size(F.filter(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), lambda x: x.rlike(f"[{WORD}]$")))
        return F.when(F.size(every) < 2, 0.0).otherwise(broken / F.greatest(F.size(every), F.lit(1)))

    return let(lines(c), ratio)


def final_score(total: Column) -> Column:
    return F.least(F.lit(100.0), rounded(F.greatest(total * SCALE, F.lit(FLOOR)), 1))


def noise_score(c: Column, kind: str = "txt", recognised: bool = False, broken: Column | None = None) -> Column:
    """0 to 100. ``kind`` is a file type; ``broken`` replaces the ratio of broken sentences."""
    kind = kind.lower().replace(".", "")
    raw = F.coalesce(c, F.lit(""))
    clean = clean_paged(raw, recognised) if kind == "pdf" else normalise_basic(raw)

    def total(clean: Column) -> Column:
        symbols, short = symbol_ratio(clean), short_line_ratio(clean)
        if kind in ("txt", "md"):
            return symbols * 25 + short * 12
        cut = broken_ratio(clean) if broken is None else broken
        if kind in ("docx", "epub", "html", "htm", "rtf"):
            return symbols * 18 + short * 10 + cut * 12
        if kind != "pdf":
            return symbols * 20 + short * 10 + cut * 10
        paged = symbols * 10 + short * 8 + cut * 12 + repeated_mark_ratio(clean) * 18 + page_artifact_ratio(raw) * 12
        return paged + odd_character_ratio(clean) * 16 + word_split_ratio(raw) * 10 if recognised else paged

    return F.when(strip(raw) == "", 100.0).otherwise(final_score(let(clean, total)))


def _shares(c: Column) -> Column:
    """``struct`` of the symbol, repeated-mark, odd-character and short-line ratios, and the lines; what is no word and no blank is cut out once, with its neighbours."""

    def of(marks: Column, every: Column) -> Column:
        n, all_ = F.length(c), F.length(F.translate(marks, " ", ""))
        plain = F.length(F.translate(marks, " .,;:!?()\"'\\-", ""))
        short = F.size(F.filter(every, lambda x: F.length(x) <= 3))
        return F.struct(share(all_, n).alias("symbols"), share(count(marks, r"([^ ])\1{2,}"), n).alias("marks"), share(plain, n).alias("odd"), share(short, F.size(every)).alias("short"), every.alias("lines"))

    return let(F.regexp_replace(c, f"[{WORD}{WS}]+", " "), lambda marks: let(lines(c), lambda every: of(marks, every)))


def noise_scores(c: Column, broken: Column) -> Column:
    """``struct<pdf, scan, rich, other>``: ``noise_score`` of paged, recognised, formatted and other files at once; cleaned texts and ratios that several of them look at are worked out once."""
    raw = F.coalesce(c, F.lit(""))

    def scores(x: Column) -> Column:
        b, cut, same = x["b"], x["cut"], x["b"] == x["raw"]
        p, r, of = x["both"]["paged"], x["both"]["scan"], x["shares"]

        def totals(y: Column) -> Column:
            pages = artifact_share(F.when(same, of["lines"]).otherwise(lines(x["raw"])))
            paged = lambda s, artifact: s["symbols"] * 10 + s["short"] * 8 + cut * 12 + s["marks"] * 18 + artifact * 12
            return let(pages, lambda artifact: F.struct(
                final_score(paged(y["p"], artifact)).alias("pdf"),
                final_score(paged(y["r"], artifact) + y["r"]["odd"] * 16 + word_split_ratio(x["raw"]) * 10).alias("scan"),
                final_score(of["symbols"] * 18 + of["short"] * 10 + cut * 12).alias("rich"),
                final_score(of["symbols"] * 20 + of["short"] * 10 + cut * 10).alias("other"),
            ))

        # most texts have no page marks
        return let(F.struct(F.when(p == b, of).otherwise(_shares(p)).alias("p"), F.when(r == b, of).otherwise(_shares(r)).alias("r")), totals)

    empty = F.struct(*[F.lit(100.0).alias(k) for k in ("pdf", "scan", "rich", "other")])
    begun = let(normalise_basic(raw), lambda b: F.struct(raw.alias("raw"), b.alias("b"), broken.alias("cut"), both_cleaned(b).alias("both"), _shares(b).alias("shares")))
    return F.when(strip(raw) == "", empty).otherwise(let(begun, scores))


def noise_label(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 35, "caution").otherwise("good")


def noise_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").when(score >= 15, "low").otherwise("good")


def caps_density(c: Column) -> Column:
    """Words of two to six capitals against all words; texts without two capitals in a row have none to count."""
    # what stands before is looked at behind the first capital, as most characters are none
    capitals = count(c, rf"[A-Z](?<![{WORD}][A-Z])[A-Z]{{1,5}}(?![{WORD}])")
    every = F.length(F.regexp_replace(c, f"[{WS}]*+[^{WS}]++[{WS}]*+", "x"))
    return F.when(c.rlike("[A-Z]{2}"), capitals / every).otherwise(0.0)


def byline_block(every: Column) -> Column:
    """Whether a text's lines are few and short, without a sentence's end."""
    return F.size(every).between(1, 4) & F.forall(every, lambda x: (F.length(x) <= 48) & ~x.rlike("[.!?。！？]"))


def noise_type(c: Column) -> Column:
    """The first type that fits, from the most protective to the most general."""

    def prose(c: Column, clean: Column, every: Column) -> Column:
        # most texts are clean, so that their own lines are known
        own = F.when(clean == c, every).otherwise(lines(c))
        score = final_score(symbol_ratio(clean) * 25 + short_share(every) * 12)
        return F.when(score >= 60, "OCR_FRAGMENT").when(let(own, byline_block), "HEADER_FOOTER").otherwise("NORMAL_CONTENT")

    kind = lambda c: (
        F.when(c == "", "PAGE_NUMBER")
        .when((F.octet_length(c) > F.length(c)) & c.rlike(f"[{SCRIPTS['he']}{SCRIPTS['el']}]") & ((count_chars(c, SCRIPTS["he"]) >= 3) | (count_chars(c, SCRIPTS["el"]) >= 3)), "ORIGINAL_LANGUAGE")
        .when(reduce(or_, map(c.endswith, string.digits)) & c.rlike(r"(?i)^(page\s+)?[0-9]+$"), "PAGE_NUMBER")
        .when(c.contains("(") & c.rlike(rf"\([^()]*(?<![{WORD}])(19|20)[0-9]{{2}}(?![{WORD}])[^()]*\)"), "BIBLIOGRAPHY")
        .when(caps_density(c) >= 0.08, "ABBREVIATION")
        .otherwise(let(normalise_basic(c), lambda clean: let(lines(clean), lambda every: prose(c, clean, every))))
    )
    return let(strip(F.coalesce(c, F.lit(""))), kind)


def noise_policy(kind: Column) -> Column:
    """``struct<policy, quality_score, section_type>`` of a noise type."""
    table = F.create_map(*[x for name, (policy, score, section) in NOISE_TYPES.items() for x in (F.lit(name), F.struct(F.lit(policy).alias("policy"), F.lit(score).alias("quality_score"), F.lit(section).alias("section_type")))])
    return table[kind]


# Weights of the boundary features, and the score from which a boundary is one.
BOUNDARY_WEIGHTS = {"heading": 100, "paragraph": 30, "tiny": -60, "sentence_end": 10, "reference": 15}
BOUNDARY_LEAST = 50


def boundary_score(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of boolean features; add a feature by adding a name to both mappings."""
    weights = weights or BOUNDARY_WEIGHTS
    return sum((F.when(on, float(weights[name])).otherwise(0.0) for name, on in features.items()), F.lit(0.0))
