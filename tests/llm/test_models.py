"""Language ID, media columns and LM scoring."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlytics.llm import language_id, lm_score, media, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_cases(spark):
    texts = ["the cat and the dog", None, "", "123 --", "la maison est dans la rue", "é", "the " * 200_000 + "end", "#### \n " * 100 + "x"]
    docs = spark.createDataFrame([(i, t, "en" if t and "the" in t else "fr" if t else None, "mine") for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string, score string")
    out = language_id.predict(docs, language_id.fit(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in out[:8]] == [False, True, True, True, False, False, False, False]
    assert out[0].lang_pred == "en" and out[4].lang_pred == "fr" and out[6].lang_pred == "en"
    assert all(r.rejected and r.score == 0 for r in out if r.lang_pred == "und")
    none = language_id.predict(docs, language_id.fit(docs.filter("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0


def test_language_against_plain_python(spark):
    """Whole texts of the table and some odd ones, scored n-gram by n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    odd = [(-1, "é", None), (-2, "Ünïcode ÉCOLE straße", None), (-3, " the  end.", None), (-4, "A", None), (-5, "the cat " * 100_000, None)]
    some = docs.filter("doc_id % 40 = 0").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    table, bits = model["table"].astype(float), language_id.BITS
    for r in language_id.predict(some, model).collect():
        line = b" " + bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in r.text.lower().encode()) + b"    "
        total, n, seen = np.zeros(len(model["langs"])), 0, {}
        for i in range(len(line) - 4):
            for size, mask, k in language_id.GRAMS:
                gram = line[i : i + size]
                if b" " in gram[1:-1] or gram[1:] == b" " * (size - 1) and (size > 2 or gram[:1] == b" "):
                    continue
                seen[gram] = seen.get(gram, 0) + 1
        for gram, times in seen.items():
            mask, k = next((m, k) for size, m, k in language_id.GRAMS if size == len(gram))
            total += times * table[((int.from_bytes(gram, "little") & mask) * k & 0xFFFFFFFF) >> (32 - bits)]
            n += times
        z = (total / max(n, 1) + model["bias"]) * model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(r.score - p.max()) < 1e-3 and r.lang_pred == model["langs"][int(p.argmax())], r.text[:50]


def test_row_sums_of_long_texts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc é"), n)) for n in (0, 3, 900, 40, 2000)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    table = rng.random(((1 << language_id.BITS) + 1, 2)).astype(np.float32)
    table[-1] = 0
    whole = language_id._row_sums(data, offsets, table)
    one = np.array([sum(table[g].sum(axis=0, dtype=float) for g in language_id.ngram_ids(np.frombuffer(b" " + r, np.uint8))) for r in raw])
    assert np.abs(whole - one).max() <= 4  # a text is joined with the blank before the next
    for size in (1, 7, 64, 500):
        pieced = language_id._row_sums(data, offsets, table, size)
        assert np.allclose(pieced[[2, 4]], one[[2, 4]], atol=1e-2)  # the long ones, exactly


def test_media_round_trip(spark):
    texts = [None, "", "a", "é🙂" * 40, "x" * 64, "y" * 6400, "z" * 65 + "é"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts * 2)], "doc_id long, text string, feature string").withColumn("payload", media.text_payload(F.col("text")))
    rows = media.read_media(media.store_media(docs)).orderBy("doc_id").collect()
    for r in rows:
        raw = (r.text or "").encode()
        assert bytes(r.stored) == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0") and r.n_bytes == len(raw)
        assert len(r.rgb) == r.height * r.width * 3
    assert len({(bytes(r.media), r.feature) for r in rows if r.text in (None, "")}) == 1
    assert [r.feature for r in rows[: len(texts)]] == [r.feature for r in rows[len(texts) :]]
    assert media.read_media(media.store_media(docs.limit(0))).count() == 0


def test_media_table(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op2_media(spark, SF).collect():
        padded = docs[r.doc_id].ljust(max(1, -(-len(docs[r.doc_id]) // 64)) * 64, b"\0")
        assert r.rgb_bytes == 3 * np.prod([int(n) for n in r.feature.split(":")[0].split("x")])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def plain_picture(payload):
    """The tensor of a stored payload, block by block: coefficients 256 + byte of unit steps, 4:2:0 chroma repeated."""
    padded = payload.ljust(max(1, -(-len(payload) // 64)) * 64, b"\0")
    columns, rows = media.shape_of(len(padded) // 64)
    blocks = np.full((6 * columns * rows, 64), 256.0)
    found = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    blocks[: len(found)] += found
    k = np.arange(8)
    c = np.where(k == 0, math.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * math.pi / 16)
    units = columns * rows

    def plane(part, across):
        out = np.zeros((len(part) // across * 8, across * 8))
        for i, block in enumerate(part):
            square = np.zeros(64)
            square[media.ZIGZAG] = block
            y, x = divmod(i, across)
            out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = c.T @ square.reshape(8, 8) @ c
        return np.clip(np.round(out + 128), 0, 255)

    y, cb, cr = plane(blocks[: 4 * units], 2 * columns), plane(blocks[4 * units : 5 * units], columns), plane(blocks[5 * units :], columns)
    cb, cr = (p.repeat(2, 0).repeat(2, 1) - 128 for p in (cb, cr))
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)


def test_tensors_and_long_payloads(spark):
    texts = ["short", "some words of a text " * 30, "é" * 40_000, "x" * 3_000_000]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, height string").withColumn("payload", media.text_payload(F.col("text")))
    for r in media.read_media(media.store_media(docs)).collect():
        raw = r.text.encode()
        assert bytes(r.stored) == raw.ljust(-(-len(raw) // 64) * 64, b"\0")
        if len(raw) < 10**6:
            rgb = np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3)
            assert np.abs(rgb - plain_picture(raw)).max() <= 3
            means = [int(m) for m in r.feature.split(":")[1].split(",")]
            assert np.abs(np.array(means) / 1000 - rgb.reshape(-1, 3).mean(axis=0)).max() < 0.01


class Writer:
    """A plain writer of progressive scans with 8-bit codes, to test the general reader."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def size_value(self, v):
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def progressive(coefs, width, height, split=5):
    """A gray file of (blocks, 64) coefficients: DC with one bit refined, two bands with end-of-band runs, refined once."""
    table = lambda kind: media._segment(0xC4, bytes([kind << 4, *[0] * 8, 255, *[0] * 7][:17]) + bytes(range(255)))
    table = lambda kind: media._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255)))
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes(range(1, 65))), media._segment(0xC2, b"\x08" + height.to_bytes(2) + width.to_bytes(2) + bytes([1, 1, 0x11, 0])), table(0), table(1)]
    w, before = Writer(), 0
    for b in coefs:
        v = int(b[0]) >> 1
        n, bits = w.size_value(v - before)
        w.put(n, 8), w.put(bits, n)
        before = v
    out += [media._sos(1, 0, 0, 0, 1), w.done()]
    w = Writer()
    for b in coefs:
        w.put(int(b[0]) & 1, 1)
    out += [media._sos(1, 0, 0, 1, 0), w.done()]
    half = lambda v: (abs(int(v)) >> 1) * (1 if v > 0 else -1)
    for ss, se in ((1, split), (split + 1, 63)):
        w, eob = Writer(), 0

        def close(w=w):
            nonlocal eob
            if eob:
                n = eob.bit_length() - 1
                w.put(n << 4, 8), w.put(eob - (1 << n), n)
            eob = 0

        for b in coefs:
            run = 0
            for k in range(ss, se + 1):
                if v := half(b[k]):
                    close()
                    while run > 15:
                        w.put(0xF0, 8)
                        run -= 16
                    n, bits = w.size_value(v)
                    w.put(run << 4 | n, 8), w.put(bits, n)
                    run = 0
                else:
                    run += 1
            eob += run > 0
        close()
        sos = bytearray(media._sos(1, ss, se, 0, 1))
        sos[6] = 0
        out += [bytes(sos), w.done()]
        w = Writer()
        for b in coefs:
            last = max((k for k in range(ss, se + 1) if abs(int(b[k])) == 1), default=ss - 1)
            run, held = 0, []
            for k in range(ss, last + 1):
                v = int(b[k])
                if abs(v) > 1:
                    held.append(abs(v) & 1)
                elif v == 0:
                    if run == 15:
                        w.put(0xF0, 8)
                        for x in held:
                            w.put(x, 1)
                        run, held = 0, []
                    else:
                        run += 1
                else:
                    w.put(run << 4 | 1, 8), w.put(int(v > 0), 1)
                    for x in held:
                        w.put(x, 1)
                    run, held = 0, []
            if last < se:
                w.put(0, 8)
                for k in range(last + 1, se + 1):
                    if abs(int(b[k])) > 1:
                        w.put(abs(int(b[k])) & 1, 1)
        sos = bytearray(media._sos(1, ss, se, 1, 0))
        sos[6] = 0
        out += [bytes(sos), w.done()]
    return b"".join([*out, b"\xff\xd9"])


def test_general_progressive_files():
    rng = np.random.default_rng(2)
    coefs = np.where(rng.random((12, 64)) < 0.3, rng.integers(-9, 10, (12, 64)), 0)
    coefs[3:6, 1:] = 0
    coefs[7, 63] = 1
    coefs[:, 0] = rng.integers(-100, 100, 12)
    data = progressive(coefs, 30, 17)
    (_, f, found, rgb, _), *rest = media.decode_many([data])
    assert not rest and (found[1] == coefs).all() and rgb.shape == (3, 17, 30)
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    block = np.zeros(64)
    block[media.ZIGZAG] = coefs[0] * np.arange(1, 65)
    want = np.clip(np.rint(c.T @ block.reshape(8, 8) @ c + 128), 0, 255)
    assert np.abs(rgb[0, :8, :8] - want).max() <= 1
    with pytest.raises(ValueError):
        media.parse(b"no file")


def test_fixed_places_agree_with_general_reader():
    rng = np.random.default_rng(1)
    files = media.encode_many(rng.integers(0, 256, (3, 40, 64), dtype=np.uint8), [2560] * 3)
    for i, _, found, _, _ in media.decode_many(files):
        _, slow = media.decode_file(files[i])
        assert all((slow[k].reshape(-1, 64) == v).all() for k, v in found.items())


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media.ZIGZAG[-3:].tolist() == [55, 62, 63]


def noisy(rng, size, spread, kind):
    m = lm_score.new_model(lm_score.make_classes(rng.integers(0, 50, size))[0])
    return {k: v if k == "class" else (v + rng.normal(0, spread, v.shape)).astype(kind) for k, v in m.items()}


def test_gradients():
    rng = np.random.default_rng(4)
    m = noisy(rng, 500, 0.05, np.float64)
    x, y, _ = lm_score.windows([40, 7], rng.integers(0, 500, 47), 500)
    _, g = lm_score.gradients(m, x, y)
    own = np.zeros_like(m["own"])
    own[g["own"][0]] = g["own"][1]
    for k in (*lm_score.DENSE, "own"):
        at = tuple(rng.integers(0, n) for n in m[k].shape) if k not in ("emb", "own") else (int(m["class"][x[1, 20]]) if k == "emb" else int(x[1, 20]), 3)
        keep, step = m[k][at], 1e-5
        m[k][at] = keep + step
        up, _ = lm_score.gradients(m, x, y)
        m[k][at] = keep - step
        down, _ = lm_score.gradients(m, x, y)
        m[k][at] = keep
        assert abs((up - down) / (2 * step) - (own if k == "own" else g[k])[at]) < 1e-4, k


def test_windows_text_by_text():
    rng, size = np.random.default_rng(8), 90
    lengths = np.array([1, 16, 17, 5, 32, 33])
    flat = rng.integers(0, size, lengths.sum())
    x, y, text = lm_score.windows(lengths, flat, size)
    at = 0
    for i, ids in enumerate(np.split(flat, np.cumsum(lengths)[:-1])):
        line = [size + 1] * lm_score.HALF + [size, *ids[:-1]] + [size + 1] * lm_score.HALF
        for w in range(0, len(ids), lm_score.HALF):
            assert x[at].tolist() == line[w : w + 2 * lm_score.HALF] and text[at] == i
            assert y[at].tolist() == (ids[w : w + lm_score.HALF].tolist() + [-1] * lm_score.HALF)[: lm_score.HALF]
            at += 1
    assert at == len(x)


def test_scoring_tables_agree_with_forward():
    rng = np.random.default_rng(6)
    m = noisy(rng, 700, 0.2, np.float32)
    x, y, _ = lm_score.windows([2000, 500], rng.integers(0, 700, 2500), 700)
    z = lm_score.forward(m, x)["z"].astype(np.float64)
    t = y.reshape(-1)
    want = np.where(t >= 0, (z[np.arange(len(t)), m["class"][np.maximum(t, 0)]] - np.log(np.exp(z).sum(axis=1))) / math.log(10), 0)
    assert np.abs(lm_score.log10_of(lm_score.tables_of(m), x, y) - want).max() < 1e-3


def test_chunks_change_no_id(monkeypatch):
    ranks = lm_score.load_vocabulary()
    texts = ["it's  the end, isn't it? " * 40, "one two\n three 4 5!? " * 30, "é 🙂  ü" * 50]
    whole = [lm_score.subwords(t, ranks).tolist() for t in texts]
    monkeypatch.setattr(lm_score, "CHUNK", 48)
    assert [lm_score.subwords(t, ranks).tolist() for t in texts] == whole
    monkeypatch.undo()
    for long in (" " * 1_200_000, "\n" * 1_200_000, "x" * 300_000, "- " * 300_000):
        ids = lm_score.subwords(long, ranks)
        back = {v: k for k, v in ranks.items()}
        assert b"".join(back[i] for i in ids[:-1].tolist()).decode() == long


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "the end"), (-1, None), (-5, " " * 1_000_000 + "end")], "doc_id long, text string"))
    rows = docs.collect()
    learn = F.coalesce(queries.crc_mod(F.col("doc_id"), 5) != 1, F.lit(True))
    ranks = lm_score.load_vocabulary()
    coded = lm_score.encode(docs.withColumns({"target": F.lit("x"), "block": F.lit(1), "learn": F.lit("y")}), learn)
    fitted = lm_score.fit(coded)
    got = lm_score.score(coded, fitted).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    by_id = {d: (held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        h, tokens, known, base = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    d, text = next((d, t) for d, t in rows if t and 500 < len(t) < 2000)
    ids = lm_score.subwords(text, ranks)
    tables, total = lm_score.tables_of(fitted["model"]), fitted["share"][ids].sum()
    for i in range(len(ids)):  # position by position
        x, y, _ = lm_score.windows([i + 1], ids[: i + 1], fitted["size"])
        total += lm_score.log10_of(tables, x[-1:], y[-1:])[i % lm_score.HALF]
    one = lm_score.score_texts([text], fitted, ranks)[0]
    assert abs(one - total) < 1e-3 * abs(total) and abs(next(r.score for r in got if r.doc_id == d) - one) < 1e-3 * abs(total)
    # held-out log10 per subword: better than a model that sees the last class alone, than one without ids, and than the subwords' shares
    ours = [(r.doc_id, r.score) for r in got if r.held_out]
    texts = dict((d, t) for d, t in rows)
    many = sum(len(lm_score.subwords(texts[d], ranks)) for d, _ in ours)
    mean = lambda m: lm_score.score_texts([texts[d] for d, _ in ours], fitted | {"model": m}, ranks).sum() / many
    m = fitted["model"]
    last, classes, unigram = mean(m | {"u": m["u"] * 0}), mean(m | {"own": m["own"] * 0}), mean(m | {"u": m["u"] * 0, "bigram": m["bigram"] * 0})
    model = sum(s for _, s in ours) / many
    print("log10 per subword:", model, "classes alone", classes, "last class", last, "unigram", unigram)
    assert model > last + 0.05 and model > classes + 0.02 and last > unigram
    assert model > OF_CLASSES
    empty = lm_score.encode(docs.limit(0), learn)
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0
    assert lm_score.score(empty, fitted).count() == 0


#: What a model over 128 classes alone, without ids, reached on the same texts (measured in the round before).
OF_CLASSES = -1.950


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    coded = lm_score.encode(docs, F.lit(False))
    rows = {r.doc_id: r for r in lm_score.score(coded, lm_score.fit(coded)).collect()}
    assert [(r.n_known, r.train_tokens, r.held_out) for r in rows.values()] == [(0, 0, True)] * 2
    assert abs(rows[1].base_score) < 1e-9 and rows[1].score < rows[2].score < 0


def test_class_model_is_a_distribution():
    cls, share = lm_score.make_classes(np.random.default_rng(0).integers(0, 50, 1000))
    assert np.allclose(np.bincount(cls, 10.0**share), 1)


def test_every_training_window_is_learned_from(spark):
    rows = [(i, f"one two three four five six seven eight nine ten {i} " * n) for i, n in enumerate([1, 3, 400, 2] * 10)] + [(None, None), (100, "")]
    ranks = lm_score.load_vocabulary()
    coded = lm_score.encode(spark.createDataFrame(rows, "doc_id long, text string"), F.coalesce(F.col("doc_id") % 4 != 3, F.lit(True)))
    fitted = lm_score.fit(coded, steps=5)
    assert fitted["trained"] == sum(len(lm_score.subwords(t, ranks)) for d, t in rows if d is None or d % 4 != 3)


def test_sums_by_number():
    rng = np.random.default_rng(2)
    index, rows = rng.integers(0, 40, 300), rng.normal(0, 1, (300, 5)).astype(np.float32)
    found, sums = lm_score._row_sums(index, rows)
    assert sorted(found.tolist()) == sorted(set(index.tolist()))
    assert all(np.allclose(s, rows[index == i].sum(axis=0), atol=1e-5) for i, s in zip(found, sums, strict=True))


def test_training_grows_with_the_texts(spark):
    rows = [(i, "one two three four five six seven eight nine ten " * n) for i, n in enumerate([1, 3, 400, 2] * 10)] + [(None, None), (-1, "")]
    ranks = lm_score.load_vocabulary()
    coded = lm_score.encode(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    fitted = lm_score.fit(coded, start_windows=0, window_share=1.0)  # no first weights: all comes from the passes over the table
    every = sum(len(lm_score.subwords(t, ranks)) for _, t in rows)
    assert fitted["trained"] == every
    assert 0.1 * every < lm_score.fit(coded, start_windows=0, window_share=0.25)["trained"] < 0.4 * every
    m, fresh = fitted["model"], lm_score.new_model(fitted["model"]["class"][:-2])
    start = {k: v if k in ("b", "bigram") else fresh[k] for k, v in m.items()}
    now, first, none = (lm_score.score_texts([rows[2][1]], fitted | {"model": x}, ranks)[0] for x in (m, start, fresh))
    assert now > first > none


def test_graphs_agree_with_numpy():
    rng = np.random.default_rng(9)
    size = 500
    m = noisy(rng, size, 0.1, np.float32)
    x, y, _ = lm_score.windows([700, 40, 7, 1, 300], rng.integers(0, size, 1048), size)
    plain, fast = lm_score.Adam(m), lm_score.adam_of(m)
    assert isinstance(fast, lm_score.GraphAdam)  # the runtime is there, so the fast way is taken
    for rows in np.array_split(rng.permutation(len(x)), 5):
        plain(x[rows], y[rows], 0.004)
        fast(x[rows], y[rows], 0.004)
    got = fast.m
    # a gradient that is 0 but for rounding has a step of its own in either way: a few numbers may differ
    assert all(np.quantile(np.abs(plain.m[k] - got[k]), 0.999) < 1e-4 for k in (*lm_score.DENSE, "own")) and (plain.times == fast.times).all()
    assert all(np.abs(m[k] - got[k]).max() > 0.01 for k in (*lm_score.DENSE, "own"))
    tables = lm_score.tables_of(got)
    want = lm_score.log10_of(tables, x, y)
    assert np.abs(lm_score.log10_of(tables, x, y, run=lm_score.graph_of(got)) - want).max() < 1e-4 and (want[y.reshape(-1) < 0] == 0).all()


def test_without_the_runtime(monkeypatch):
    m = noisy(np.random.default_rng(9), 90, 0.1, np.float32)
    monkeypatch.setitem(sys.modules, "onnxruntime", None)
    assert lm_score.graph_of(m) is None and type(lm_score.adam_of(m)) is lm_score.Adam
