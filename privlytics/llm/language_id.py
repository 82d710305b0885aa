"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and cut into the byte n-grams (2 to 4) of its words, with a mark at both ends of a word; n-grams
are hashed into ``2**BITS`` embeddings of ``DIM`` numbers, their mean goes through a linear softmax. Embeddings and softmax
are trained by stochastic gradient descent in numpy in one task, on a sample of labelled texts whose size is bounded by
``per_lang`` texts (on average) for each language; each text comes as its n-gram counts,
so no more than ``2**BITS`` numbers. The model is embeddings times softmax as one table of ``2**BITS`` x languages floats.

Rejection is calibrated on a part of the sample that training has not seen: a temperature is fitted to its likelihood,
and a text is rejected if its calibrated probability is below that which all but ``reject`` of the rightly predicted
calibration texts reach. Texts without a letter are ``und`` and rejected.

Whole texts are read; very long ones in pieces of bounded size that overlap, so that each n-gram counts once. Cases: null or empty text and text without letters: ``und``, score 0,
rejected. Null labels are not learned from. Without any label every text is ``und``. Repeated rows have equal results.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, tidy

BITS, DIM, PIECE = 15, 16, 1 << 20
#: By n-gram length: mask of a little-endian group of four bytes, and an odd multiplier.
GRAMS = ((2, 0xFFFF, 0x9E3779B1), (3, 0xFFFFFF, 0x85EBCA6B), (4, 0xFFFFFFFF, 0xC2B2AE35))


def _byte_classes() -> np.ndarray:
    """Letters and all bytes over 127 stay, anything else becomes a blank."""
    table = np.full(256, 32, np.uint8)
    for lo, hi in ((97, 122), (128, 255)):
        table[lo : hi + 1] = np.arange(lo, hi + 1)
    return table


def ngram_ids(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each length; ``2**BITS`` where it is no subword."""
    x = _byte_classes()[data]
    padded = np.concatenate([x, np.full(4, 32, np.uint8)]).astype(np.uint32)
    n = len(x)
    b0, b1, b2, b3 = (padded[i : i + n] for i in range(4))
    word = b0 | b1 << np.uint32(8) | b2 << np.uint32(16) | b3 << np.uint32(24)
    blank0, blank1, blank2 = b0 == 32, b1 == 32, b2 == 32
    none = {2: blank0 & blank1, 3: blank1, 4: blank1 | blank2}
    out = []
    for size, mask, k in GRAMS:
        ids = ((word & np.uint32(mask)) * np.uint32(k)) >> np.uint32(32 - BITS)
        ids[none[size]] = 1 << BITS
        out.append(ids)
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(upto, n)
        at = min(upto, n)


def text_grams(data: np.ndarray, size: int = PIECE) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of one text, piece by piece; pieces overlap by what the longest n-gram needs."""
    line = np.concatenate([np.full(1, 32, np.uint8), data])  # the first word has its mark
    for at in range(0, len(line), size):
        for ids in ngram_ids(line[at : at + size + 3]):
            yield ids[:size]


def _row_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, size: int = PIECE) -> np.ndarray:
    """For each row the sum of ``table`` over its n-grams; a last column of ones makes this their count as well."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for a, b in pieces(offsets, size):
        if b == a + 1 and offsets[b] - offsets[a] > size:
            for ids in text_grams(data[offsets[a] : offsets[b]], size):
                out[a] += table[ids].sum(axis=0, dtype=np.float64)
            continue
        # a blank before each text: words at its ends have their marks
        starts = offsets[a:b] - offsets[a] + np.arange(b - a)
        text = np.full(offsets[b] - offsets[a] + (b - a), 32, np.uint8)
        where = np.ones(len(text), bool)
        where[starts] = False
        text[where] = data[offsets[a] : offsets[b]]
        for ids in ngram_ids(text):
            out[a:b] += np.add.reduceat(table[ids], starts, axis=0)
    return out


def _lower(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(batch.column("text"))


def _sample(docs: DataFrame, per_lang: int, learn: Column) -> DataFrame:
    """(key, lang, ids, counts, calib): n-gram counts of a bounded sample of labelled texts."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    sizes = known.groupBy("lang").count()
    rates = broadcast_if_small(sizes.select("lang", (F.lit(float(per_lang)) / F.col("count")).alias("rate")), F.octet_length("lang") + 32)
    drawn = known.join(rates, "lang").filter(F.crc32(F.concat(F.lit("fit"), F.coalesce("key", F.lit("")))) / 2.0**32 < F.col("rate"))
    drawn = drawn.select("key", "lang", "text", (F.crc32(F.concat(F.lit("calib"), F.coalesce("key", F.lit("")))) % 4 == 0).alias("calib"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(_lower(batch))
            ids, counts = [], []
            for i in range(batch.num_rows):
                total = np.zeros((1 << BITS) + 1, np.int64)
                for g in text_grams(data[offsets[i] : offsets[i + 1]]):
                    total += np.bincount(g, minlength=len(total))
                found = np.flatnonzero(total[:-1])
                ids.append(found.astype(np.int32))
                counts.append(total[found].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), batch.column("calib")], ["key", "lang", "ids", "counts", "calib"])

    return drawn.mapInArrow(tidy(count), "key string, lang string, ids array<int>, counts array<float>, calib boolean")


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, learn: Column | None = None, per_lang: int = 1000, epochs: int = 4, rate: float = 0.5, reject: float = 0.002, seed: int = 7) -> dict:
    """The model: langs, table (buckets x langs), bias, temperature, threshold. It is trained in one task, on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, calib, ids, counts = [], [], [], []
        for batch in batches:
            lang += batch.column("lang").to_pylist()
            calib += batch.column("calib").to_pylist()
            for name, held in (("ids", ids), ("counts", counts)):
                column = batch.column(name)
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
                held += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if lang:
            out = io.BytesIO()
            np.savez(out, **train(lang, np.array(calib, bool), ids, counts, epochs, rate, reject, seed))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    sample = _sample(docs, per_lang, F.lit(True) if learn is None else learn)
    got = sample.repartition(1).sortWithinPartitions("key", "lang").mapInArrow(tidy(run), "model binary").collect()  # one row: the model
    if not got:
        return {"langs": [], "table": np.zeros(((1 << BITS) + 1, 1), np.float32), "bias": np.zeros(0), "temperature": 1.0, "threshold": 1.0}
    found = np.load(io.BytesIO(bytes(got[0].model)))
    return {"langs": found["langs"].tolist(), "table": found["table"], "bias": found["bias"], "temperature": float(found["temperature"]), "threshold": float(found["threshold"])}


def train(lang: list[str], calib: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], epochs: int = 4, rate: float = 0.5, reject: float = 0.002, seed: int = 7) -> dict:
    """Stochastic gradient descent over texts as n-gram counts; those of ``calib`` only calibrate."""
    langs = sorted(set(lang))
    y = np.array([{x: i for i, x in enumerate(langs)}[x] for x in lang])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, ((1 << BITS) + 1, DIM)).astype(np.float32)
    emb[-1] = 0
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    train = [i for i in range(len(y)) if not calib[i] and len(ids[i])]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            weight = counts[i] / counts[i].sum()
            hidden = weight @ emb[ids[i]]
            g = _softmax((hidden @ w + bias)[None])[0]
            g[y[i]] -= 1
            back = w @ g
            w -= step * np.outer(hidden, g)
            bias -= step * 0.1 * g
            emb[ids[i]] -= (step * 8 * weight)[:, None] * back
    table = emb @ w
    held = [i for i in range(len(y)) if calib[i] and len(ids[i])] or train
    z = np.stack([counts[i] @ table[ids[i]] / counts[i].sum() + bias for i in held]) if held else np.zeros((0, len(langs)))
    truth = y[held]
    grid = np.geomspace(0.25, 16, 25)
    loss = [-np.log(_softmax(z * t)[np.arange(len(held)), truth] + 1e-12).mean() if held else 0 for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z * t)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth]) if held else np.ones(1)
    threshold = float(min(0.5, right[int(reject * len(right))])) if len(right) else 0.5
    return {"langs": langs, "table": table, "bias": bias, "temperature": t, "threshold": threshold}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (with ``text``) with lang_pred, score and rejected; columns of these names are replaced."""
    langs, t, threshold = model["langs"], model["temperature"], model["threshold"]
    table = np.concatenate([model["table"], np.ones((len(model["table"]), 1), np.float32)], axis=1).astype(np.float32)
    table[-1] = 0  # what is no subword counts as none
    bias = np.asarray(model["bias"], np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2**BITS x languages floats
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    letter = re.compile(r"[^\W\d_]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _lower(batch)
            data, offsets = texts_of(low)
            sums = _row_sums(data, offsets, shared.value)
            ascii_letter = np.zeros(256, np.int64)
            ascii_letter[97:123] = 1
            has = np.array([bool(ascii_letter[data[offsets[i] : min(offsets[i] + 200, offsets[i + 1])]].any()) for i in range(batch.num_rows)], bool)
            for i in np.flatnonzero(~has):
                has[i] = any(letter.search(part) for part in [low[int(i)].as_py() or ""])
            if langs:
                p = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + bias) * t)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score, has = np.zeros(len(has), int), np.zeros(len(has)), np.zeros(len(has), bool)
            pred = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            score = np.where(has, score, 0.0)
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(~has | (score < threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, rejected boolean")
