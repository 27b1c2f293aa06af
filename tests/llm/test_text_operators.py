"""Encoders, media, language, quality and packing against brute force, round trips or held-out accuracy."""

import hashlib
import zlib

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.llm import byte_bpe, language, packing, quality, transport_stream
from lectern.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
MULTI = "byte_bpe_multi_50k.tiktoken"


def reference_encoder():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(MULTI), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


STRANGE = ["", " ", "a", "hello world", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "x" * 5000, "\n\n\n   tabs\t\t", "漢字かな交じり文" * 50, "🙂🙂👩‍👩‍👧", "don't we'll I'M", "<|endoftext|>", "12345 67,890", "Ünïcödé" * 300, "\u0000\u0001", "ab" * 700]


def test_op4_equals_the_public_encoder(spark, odd):
    theirs = reference_encoder()
    bpe = byte_bpe.load(tokenizer_path(MULTI), public_tokenizers.PATTERN)
    for text, ids in zip(STRANGE, bpe.encode_batch(STRANGE)):
        assert ids.tolist() == theirs.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    rows = byte_bpe.encode(odd, tokenizer_path(MULTI), public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count() and all(list(r.ids) == theirs.encode_ordinary(r.text or "") and r.decoded == (r.text or "") for r in rows)
    assert byte_bpe.encode(odd.limit(0), tokenizer_path(MULTI), public_tokenizers.PATTERN).count() == 0


def test_op4_query_over_the_whole_table(spark):
    theirs = reference_encoder()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op4_byte_bpe"](spark, SF).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op2_round_trip_and_damage(spark, odd):
    for size in (1, 63, 64, 157, 158, 8000, transport_stream.UNIT, transport_stream.UNIT + 1, 300_000):
        payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
        media = transport_stream.multiplex(payload)
        stream = transport_stream.demultiplex(media)
        assert stream.payload == payload and stream.cc_errors == 0 and not len(media) % 188
        assert stream.units[0][3] and [u[0] for u in stream.units] == [k * transport_stream.TICKS for k in range(len(stream.units))]
    lost = media[: 188 * 10] + media[188 * 11 :]
    damaged = transport_stream.demultiplex(lost)
    assert damaged.cc_errors == 1 and sum(u[4] for u in damaged.units) == 1
    bad = [(b"",), (b"x" * 188,), (None,), (b"G" * 188,), (media[:100],)]
    rows = transport_stream.decode_media(spark.createDataFrame(bad, "media binary")).collect()
    assert all(r.payload is None for r in rows) and sum(r.problem is not None for r in rows) == 4
    for r in transport_stream.media_digests(odd.select("doc_id", "text", "units")).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0


def packet(pid, counter, body=b"", start=False, adaptation=None):
    """One packet by hand; what the body leaves open is stuffing in the adaptation field."""
    room = 184 - len(body)
    if adaptation is None and not room:
        field = b""
    else:
        flags = adaptation or b"\0"
        field = b"\0" if room == 1 else bytes([room - 1]) + flags + b"\xff" * (room - 1 - len(flags))
    head = bytes([0x47, 0x40 * start | pid >> 8, pid & 255, 0x20 * bool(field) | 0x10 * bool(body) | counter & 15])
    return head + field + body


def section(table, number, body, version=0, current=1):
    head = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC0 | version << 1 | current, 0, 0]) + body
    crc = 0xFFFFFFFF
    for bit in (b >> k & 1 for b in head for k in range(7, -1, -1)):
        crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (crc >> 31) ^ bit else 0)
    return head + crc.to_bytes(4, "big")


def foreign(first_length=True):
    """Two programs, a program table over two packets, and two streams mixed with each other."""
    pat = b"\0" + section(0, 1, bytes([0, 1, 0xE1, 0x00, 0, 2, 0xE1, 0x10]))
    info = b"\x05\x04ABCD" * 32
    pmt = section(2, 1, bytes([0xE0, 0x50, 0xF0 | len(info) >> 8, len(info) & 255]) + info + bytes([0x1B, 0xE0, 0x50, 0xF0, 0, 0x0F, 0xE0, 0x51, 0xF0, 0]))
    other = b"\0" + section(2, 2, bytes([0xE0, 0x60, 0xF0, 0, 0x02, 0xE0, 0x60, 0xF0, 0]))
    pts, dts = b"\x31\x00\x01\x1c\x41", b"\x11\x00\x01\x0e\x21"
    video = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + pts + dts + bytes(range(256)) * 2
    sound = b"\0\0\1\xc0" + (3 + 300).to_bytes(2, "big") + b"\x80\0\0" + b"s" * 300
    return [
        packet(0, 0, pat, True), packet(0x100, 3, (b"\0" + pmt)[:184], True), packet(0x110, 0, other, True), packet(0x100, 4, (b"\0" + pmt)[184:]),
        packet(0x50, 14, video[:150], True, b"\x50" + b"\0" * 6), packet(0x51, 0, sound[:184], True), packet(0x50, 15, video[150:334]), packet(0x51, 1, sound[184:]), packet(0x50, 0, video[334:518]), packet(0x50, 1, video[518:]),
        packet(0x50, 2, video[:184], True), packet(0x50, 3, video[184:368]), packet(0x50, 4, video[368:]), packet(0x1FFF, 0, b"n" * 184),
    ]


def test_op2_streams_of_other_makers():
    packets, wanted = foreign(), bytes(range(256)) * 2
    stream = transport_stream.demultiplex(b"".join(packets))
    assert stream.programs == {1: [(0x50, 0x1B), (0x51, 0x0F)], 2: [(0x60, 0x02)]} and stream.payload == wanted * 2 and stream.cc_errors == 0
    assert [(u[3], u[4]) for u in stream.units] == [(True, False), (False, False)] and (stream.units[0][0], stream.units[0][5]) == (3600 + 16, 1800 + 8)
    sound = transport_stream.demultiplex(b"".join(packets), pid=0x51)
    assert sound.payload == b"s" * 300 and sound.units[0][0] == -1
    with pytest.raises(ValueError, match="no such stream"):
        transport_stream.demultiplex(b"".join(packets), program=9)
    repeated = transport_stream.demultiplex(b"".join(packets[:7] + [packets[6]] + packets[7:]))
    assert repeated.payload == wanted * 2 and repeated.cc_errors == 0
    cut = transport_stream.demultiplex(b"".join(packets[:8] + packets[9:]))
    assert cut.payload == wanted and cut.cc_errors == 1 and [u[4] for u in cut.units] == [True, False]


def test_op2_fifteen_lost_packets_are_no_repeat():
    payload = np.random.default_rng(0).integers(0, 256, 60 * 184, dtype=np.uint8).tobytes()
    media = transport_stream.multiplex(payload)
    lost = transport_stream.demultiplex(media[: 188 * 8] + media[188 * 23 :])
    assert lost.cc_errors == 1 and lost.units[0][4]


def test_op2_declared_discontinuity_is_no_error():
    packets = foreign()
    packets[10] = packet(0x50, 9, (b"\0\0\1\xe0\0\0\x80\0\0" + b"z" * 150), True, b"\x80")
    packets[11:13] = []
    stream = transport_stream.demultiplex(b"".join(packets))
    assert stream.cc_errors == 0 and stream.payload == bytes(range(256)) * 2 + b"z" * 150


def test_op2_units_without_optional_header():
    packets = foreign()[:4]
    for k, (name, data) in enumerate([(0xBF, b"p" * 66), (0xBE, b"\xff" * 40), (0xE0, b"\x80\0\0" + b"v" * 100)]):
        packets.append(packet(0x50, k, b"\0\0\1" + bytes([name]) + len(data).to_bytes(2, "big") + data, True))
    stream = transport_stream.demultiplex(b"".join(packets))
    assert stream.payload == b"p" * 66 + b"v" * 100 and [(u[2], u[4]) for u in stream.units] == [(66, False), (0, False), (100, False)]


def test_op2_flagged_packets():
    wanted = bytes(range(256)) * 2
    flagged = lambda at, byte, bits: [p if k != at else bytes(b | bits * (j == byte) for j, b in enumerate(p)) for k, p in enumerate(foreign())]
    broken = transport_stream.demultiplex(b"".join(flagged(6, 1, 0x80)))
    assert broken.payload == wanted and broken.cc_errors == 1 and [u[4] for u in broken.units] == [True, False]
    secret = transport_stream.demultiplex(b"".join(flagged(11, 3, 0x80)))
    assert secret.payload == wanted and secret.cc_errors == 0 and [u[4] for u in secret.units] == [False, True]
    with pytest.raises(ValueError, match="association"):
        transport_stream.demultiplex(b"".join(flagged(0, 1, 0x80)))


def test_op2_tables_for_later_and_later_versions():
    packets = foreign()
    table = lambda pid, **more: section(2, 2, bytes([0xE0, pid, 0xF0, 0, 0x02, 0xE0, pid, 0xF0, 0]), **more)
    packets[2] = packet(0x110, 0, b"\0" + table(0x61, current=0) + table(0x60) + table(0x62, version=1), True)
    assert transport_stream.demultiplex(b"".join(packets)).programs[2] == [(0x60, 0x02), (0x62, 0x02)]


def plain_features(media):
    """What a stream of one program holds, packet by packet."""
    counters, errors, body, starts = {}, 0, b"", []
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, start = (p[1] & 31) << 8 | p[2], bool(p[1] & 0x40)
        field = 1 + p[4] if p[3] & 0x20 else 0
        if pid in counters and p[3] & 0x10 and p[3] & 15 != (counters[pid] + 1) % 16:
            errors += 1
        counters[pid] = p[3] & 15
        if pid == transport_stream.STREAM_PID:
            if start:
                starts.append((len(body), bool(field > 1 and p[5] & 0x40)))
            body += p[4 + field :]
    units = []
    for (a, key), b in zip(starts, [s for s, _ in starts[1:]] + [len(body)]):
        pes = body[a:b]
        stamp = (pes[9] >> 1 & 7) << 30 | (pes[10] << 8 | pes[11]) >> 1 << 15 | (pes[12] << 8 | pes[13]) >> 1
        units.append((stamp, key, pes[9 + pes[8] :]))
    payload = b"".join(u[2] for u in units)
    return f"pid={transport_stream.STREAM_PID};type={{}};packets={len(media) // 188};units={len(units)};rap={sum(u[1] for u in units)};pts={units[0][0]}-{units[-1][0]};cc_errors={errors};sum={sum(payload)};max={max(payload)}", [u[0] for u in units if u[1]], payload


def test_op2_digests_by_a_plain_parser(spark, odd):
    rows = transport_stream.media_digests(odd.select("doc_id", "text")).collect()
    for r, t in zip(sorted(rows, key=lambda r: r.payload_sha256), sorted((t or "" for t in (x.text for x in odd.collect())), key=lambda t: hashlib.sha256(transport_stream.padded(t)[0]).hexdigest())):
        media = transport_stream.multiplex(transport_stream.padded(t)[0])
        feature, stamps, payload = plain_features(media)
        kind = r.feature.split("type=")[1].split(";")[0]
        assert (r.media_bytes, r.media_sha256, r.feature, r.random_access_pts) == (len(media), hashlib.sha256(media).hexdigest(), feature.format(kind), stamps) and payload == transport_stream.padded(t)[0]


def test_op2_empty_table(spark):
    assert transport_stream.media_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op2_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op2_transport_stream"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def plain_ngrams(text):
    """Letter runs between spaces, cut into n-grams of 1 to 3 symbols; a space counts as a symbol at a word's ends only."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = []
    for w in words:
        edged = f" {w} "
        for n in (1, 2, 3):
            found += [edged[k : k + n] for k in range(len(edged) - n + 1) if edged[k : k + n] != " "]
    return found


def code_of(gram):
    code = 0
    for c in gram:
        code = code << language.BITS | (language.EDGE if c == " " else ord(c))
    return code


@pytest.mark.parametrize("text", ["", "ab", "a b", "Ab, ab! ÄB 漢字 x", "42", "don't we  \n know"])
def test_op3_codes_are_those_of_strings(text):
    assert sorted(language.ngram_codes(text).tolist()) == sorted(map(code_of, plain_ngrams(text)))
    assert len({code_of(g) for g in (" a", "a", " ab", "ab", "a ")}) == 5


def test_op3_query_by_brute_force(spark):
    """Profiles, ranks and distances of the whole query over strings and dictionaries."""
    from collections import Counter

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ranked = lambda grams: [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], code_of(x[0])))][:500]
    learnt = {}
    for r in docs.values():
        if r.text is not None and r.lang and zlib.crc32(str(r.doc_id).encode()) % 5:
            learnt.setdefault(r.lang, []).extend(plain_ngrams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(grams))} for lang, grams in sorted(learnt.items())}
    got = {r.doc_id: r for r in entry.queries()["op3_language_id"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        own = ranked(plain_ngrams(docs[i].text or ""))
        cost = {lang: sum(abs(p[g] - k) if g in p else len(p) for k, g in enumerate(own)) / (len(own) * len(p)) for lang, p in profiles.items()} if own else {}
        best = min(cost, key=cost.get) if cost else "und"
        assert r.lang_pred == best and r.score == pytest.approx(1 - cost[best] if cost else 0.0) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op3_distance_by_brute_force():
    rng = np.random.default_rng(3)
    profile, document = rng.permutation(500)[:300].astype(np.int64), rng.permutation(500)[:200].astype(np.int64)
    place = {int(c): k for k, c in enumerate(profile)}
    want = sum(abs(place[int(c)] - k) if int(c) in place else len(profile) for k, c in enumerate(document))
    order = np.argsort(profile)
    assert language.out_of_place(document, profile[order], order) == want


def test_op3_held_out_accuracy_and_odd_rows(spark, odd):
    rows = entry.queries()["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    profiles = language.train_profiles(odd)
    got = language.predict_language(odd, profiles).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    empty = language.train_profiles(odd.limit(0))
    assert {r.lang_pred for r in language.predict_language(odd, empty).collect()} == {"und"}
    assert language.predict_language(odd.limit(0), profiles).count() == 0


def test_op5_held_out_ranking_and_odd_rows(spark, odd):
    rows = entry.queries()["op5_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.train(odd, labels, F.lit(True))
    got = quality.score_quality(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.train(odd, labels.limit(0), F.lit(True)) == 0.5
    assert quality.train(odd, labels.where("quality = 1"), F.lit(True)) == 1.0
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_op5_model_by_brute_force(spark):
    """Standardisation, feature map, normal equations and isotonic means over all rows at once."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    rows = docs.join(known, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("text", "y", half).collect()
    model = quality.train(docs, labels, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    stats, y, half = np.array([quality.statistics(r.text) for r in rows]), np.array([r.y for r in rows]), np.array([r.half for r in rows])
    mean, scale = stats.mean(0), stats.std(0)
    scale[scale < 1e-9] = 1.0
    np.testing.assert_allclose(model.mean, mean, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(model.scale, scale, rtol=1e-5)
    z = np.clip((stats - mean) / scale, -6, 6)
    phi = np.column_stack([np.sqrt(2 / len(model.phases)) * np.cos(sum(z[:, k] * w[k] for k in range(z.shape[1])) + b) for w, b in zip(model.frequencies.T, model.phases)] + [np.ones(len(z))])
    ridge = lambda own: np.linalg.lstsq(np.vstack([phi[own], np.sqrt(quality.RIDGE) * np.eye(phi.shape[1])]), np.concatenate([y[own], np.zeros(phi.shape[1])]), rcond=None)[0]
    np.testing.assert_allclose(phi @ model.weights, phi @ ridge(slice(None)), atol=1e-5)
    raw = np.where(half == 0, phi @ ridge(half == 1), phi @ ridge(half == 0))
    bins = np.floor(raw * quality.BINS).astype(int)
    n, p = (np.array([f(bins == b) for b in np.unique(bins)], float) for f in (np.sum, lambda own: y[own].sum()))
    # isotonic regression by its definition: the greatest over beginnings of the least over ends of the mean between
    total, good = np.concatenate(([0], n.cumsum())), np.concatenate(([0], p.cumsum()))
    fit = [max(min((good[k] - good[j]) / (total[k] - total[j]) for k in range(i + 1, len(total))) for j in range(i + 1)) for i in range(len(n))]
    blocks = [np.flatnonzero(np.isclose(fit, v)) for v in sorted(set(np.round(fit, 9)))]
    want = np.maximum.accumulate([(p[b].sum() + 0.5) / (n[b].sum() + 1) for b in blocks])
    assert abs(len(model.levels) - len(want)) <= 2 and np.abs(np.interp(raw, model.knots, model.levels) - np.interp(raw, [raw[np.isin(bins, np.unique(bins)[b])].mean() for b in blocks], want)).max() < 0.02


@pytest.mark.parametrize("labels", ["one of each", "contradicting", "repeated"])
def test_op5_odd_labels(spark, labels):
    docs = spark.createDataFrame([(k, "good words stand here. " * 9 if k % 2 else "@@ ## !! 99") for k in range(40)] + [(1, "good words stand here again.")] * 3, "doc_id long, text string")
    rows = [(k, k % 2) for k in range(40)]
    rows = {"one of each": rows[:2], "contradicting": rows + [(k, 1 - k % 2) for k in range(40)], "repeated": rows * 3}[labels]
    model = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"), F.lit(True))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 for r in got)
    if labels == "contradicting":
        assert model == 0.5
    if labels == "repeated":
        assert all(r.predicted == r.doc_id % 2 for r in got)


def test_op5_isotonic_is_monotone():
    x, n = np.arange(50.0), np.full(50, 4.0)
    _, levels = quality.isotonic(x, n, np.random.default_rng(1).integers(0, 5, 50).astype(float))
    assert (np.diff(levels) >= 0).all()


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_op8_equals_single_best_fit(spark, seed):
    lengths = np.random.default_rng(seed).choice([1, 3, 17, 60, 61, 90, 100], 400, p=[0.05, 0.1, 0.2, 0.2, 0.2, 0.2, 0.05]).tolist()
    pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "id long, length long")
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == 400 and check_packed(rows, 100) == best_fit(lengths, 100)
    assert packing.pack(pieces.limit(0), 100).count() == 0


def test_op8_query(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op8_best_fit_packing"](spark, SF).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, parts in pieces.items():
        ids = np.array(tok.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and (p.length == 1024 or p.piece == 0)
            at += p.length
        assert at == len(ids)
    assert check_packed(rows, 1024) == best_fit([r.length for r in rows], 1024)
    odd_rows = packing.pack_documents(odd, tokenizer_path("byte_bpe_50k.json")).collect()
    assert check_packed(odd_rows, 1024) and len({r.doc_id for r in odd_rows}) == 10
