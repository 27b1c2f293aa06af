"""The queries that no SQL can check, over whole tables against plain Python."""

import hashlib
import re

import pytest
from helpers import SF

from lectern.plans.queries import QUERIES

LETTER = r"[^\W]"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def basic(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \xa0]+", " ", t)).strip()


def paged(t, scan):
    lines = [x for x in basic(t).split("\n")]
    t = "\n".join("" if re.fullmatch(r"[ \t]*[0-9]+[ \t]*", x) or re.fullmatch(r"[ \t]*page\s+[0-9]+[ \t]*", x, re.I) else x for x in lines)
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    if scan:
        t = re.sub(r"\b([A-Z]) ([a-z]{2,})\b", r"\1\2", t)
        t = re.sub(r"\b([b-hj-z]) ([a-z]{1,2})\b", r"\1\2", t)
        for _ in range(5):
            t = re.sub(r"(?<=[a-z]) ([a-z]{1,3})(?= [a-z])", r"\1", t)
        t = re.sub("[~`^]{2,}", " ", re.sub("[|¦]{2,}", " ", t))
        t = "\n".join("" if re.fullmatch(r"\W{3,}", x) else x for x in t.split("\n"))
        t = re.sub("[·•※◆▶→←↑↓]{2,}", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def plain_noise(t, kind, scan=False, cut=0.0):
    if not t.strip():
        return 100.0
    c = paged(t, scan) if kind == "pdf" else basic(t)
    n, lines = max(1, len(c)), [x for x in c.split("\n") if x.strip()]
    symbols, short = len(re.findall(r"[^\w\s]", c)) / n, sum(len(x.strip()) <= 3 for x in lines) / max(1, len(lines))
    if kind == "html":
        total = symbols * 18 + short * 10 + cut * 12
    elif kind != "pdf":
        total = symbols * 20 + short * 10 + cut * 10
    else:
        raw = [x.strip() for x in t.split("\n") if x.strip()]
        page = sum(bool(re.fullmatch(r"\d+|page\s+\d+|[-–—_]{1,4}", x, re.I)) for x in raw) / max(1, len(raw))
        total = symbols * 10 + short * 8 + cut * 12 + len(re.findall(r"([^\w\s])\1{2,}", c)) / n * 18 + page * 12
        if scan:
            splits = sum(len(re.findall(p, t)) for p in (r"\b[A-Z] [a-z]{2,}\b", r"\b[b-hj-z] [a-z]{1,2}\b", r"(?<=[a-z]) [a-z]{1,3}(?= [a-z])"))
            total += len(re.findall(r"""[^\w\s.,;:!?()"'\\\-]""", c)) / n * 16 + splits / max(1.0, len(t) / 100) * 10
    return min(100.0, max(3.0, total * 14))


def joined_blocks(t):
    """Paragraphs of a text without Korean: the lines between empty lines, as one."""
    t = re.sub(r"([A-Za-z0-9])-[ \t]*\n[ \t]*([A-Za-z0-9])", r"\1\2", t.replace("\r\n", "\n").replace("\r", "\n"))
    blocks = re.split(r"\n[ \t\xa0]*(?=\n)", re.sub(r"[ \t\xa0]+", " ", t))
    return [p for p in (" ".join(x.strip() for x in b.split("\n") if x.strip()) for b in blocks) if p]


def plain_sentences(t):
    """Sentences of a text without Korean: blocks until one ends like a sentence; short ones that end nothing are joined, bullets stand alone."""
    out, last = [], ""
    for p in joined_blocks(t):
        letters = lambda s: bool(re.search("[A-Za-z]", s))
        bullet = re.match(r"\s*(?:[-•*]|\d+[.)])\s+", p)
        ended = last[-1:] in tuple(".!?") or bool(re.search("(?:다|요)$", last))
        if last and not bullet and letters(last) and letters(p):
            joins = last[-1:] not in tuple(".!?") or len(p) < 24 and p[-1:] not in tuple(".!?")
        else:
            joins = bool(last) and not bullet and (not ended or len(p) < 24 and not re.search("[.!?。！？]", p))
        out = out[:-1] + [out[-1] + " " + p] if joins else out + [p]
        last = "" if bullet else p
    return out


def test_noise_of_paged_files(spark):
    docs, checked = texts_of(spark), 0
    for r in QUERIES["noise_score_paged"](spark, SF).collect():
        t = docs[r.doc_id]
        if re.search("[가-힣֐-׿Ͱ-Ͽἀ-῿]", t):
            continue
        s = plain_sentences(t)
        cut = sum(bool(re.search("[A-Za-z0-9]$", x)) for x in s[:-1]) / len(s) if len(s) > 1 else 0.0
        want = [plain_noise(t, "pdf", False, cut), plain_noise(t, "pdf", True, cut), plain_noise(t, "html", False, cut), plain_noise(t, "", False, cut)]
        assert [r.pdf, r.scan, r.rich, r.other] == pytest.approx(want, abs=0.051), (r.doc_id, t[:200])
        checked += 1
    assert checked > 150


def tail_of(s, most):
    if len(s) <= most:
        return s.strip()
    at = re.search(r"\s", s[-most:])
    return s[-most:][at.start() :].strip() if at else ""


def plain_chunks(t, size=1200, overlap=120, least=80):
    chunks, open_ = [], []

    def close():
        held = []
        groups = []
        for u in open_:
            if held and len("\n\n".join([*held, u])) > size:
                groups.append(held)
                tail = []
                while len(tail) < len(held) - 1 and sum(len(x) + 2 for x in tail) < overlap:
                    tail = held[len(held) - 1 - len(tail) :]
                if sum(len(x) + 2 for x in tail) > 2 * overlap:
                    tail = [x for x in (tail_of(tail[0], overlap),) if x] + tail[1:]
                held = tail
            held = [*held, u]
        groups += [held] if held else []
        chunks.extend(c for c in ("\n\n".join(g).strip() for g in groups) if len(c) >= least)
        open_.clear()

    for p in joined_blocks(t):
        if len(p) <= 1.5 * size:
            open_.append(p)
            continue
        close()
        pieces, held = [], ""
        for token in re.findall(r"\s+|\S+", p):
            if len(held) + len(token) > size:
                pieces.append(held)
                held = ""
            if len(token) > size:
                pieces += [token[k : k + size] for k in range(0, len(token), size)]
                continue
            held += token
        pieces = [x.strip() for x in [*pieces, held] if x.strip()]
        if len(pieces) > 1 and len(pieces[-1]) < least:
            pieces[-2:] = [" ".join(pieces[-2:])]
        chunks += pieces
    close()
    return chunks


def test_paragraph_chunks_of_all_documents(spark):
    docs, got = texts_of(spark), {}
    for r in QUERIES["paragraph_chunks"](spark, SF).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.n, r.digest))
    checked = 0
    for doc_id, t in docs.items():
        if not re.search("[가-힣֐-׿Ͱ-Ͽἀ-῿]", t):
            want = [(len(c), hashlib.md5(c.encode()).hexdigest()) for c in plain_chunks(t)]
            assert got.get(doc_id, []) == want, doc_id
            checked += len(want)
    assert checked > 300
