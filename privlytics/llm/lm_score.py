"""LM scoring: a causal self-attention model on subword ids, and unigram counts of the whole corpus.

Subwords come from a public byte-level vocabulary (``vocabulary``: a file of ranks; never trained). The model sees subword
ids: an input is the sum of an embedding of its id, one of its class and one of its place. The output goes through classes:
subword counts over all training texts make the most frequent ids a class each, the others share ``SHARED`` classes of
about equal weight; p(subword) = p(class | context) * p(subword | class). One attention head looks over windows of
``2 * HALF`` positions, of which the second half is scored; windows overlap by ``HALF``, so each subword is scored once,
with between ``HALF`` and ``2 * HALF`` positions of context. A closing end subword is scored too.

Texts are read once: one pass writes their subword ids and the postings of their words, in blocks. Learning grows with the
corpus: counts of subwords and of all neighbouring pairs of classes (the logits given the last class alone) cover all
training texts. The weights of the attention go through every window of all training texts once, in ``ROUNDS`` rounds:
tasks go on from the common weights with the windows of their texts, and the mean of their weights, by windows (of an id's
embedding, by its occurrences), is next. So that the tasks set out from weights that can be averaged, the first ones come
from ``steps`` steps of Adam, in one task, on about ``start_windows`` windows; ``window_share`` below 1 is for tests.

Gradients and scores of windows are graphs of onnxruntime (``lm_graph``); where it is missing, numpy does the same.

Base scores use exact counts of words over all training texts. Tasks send each word's postings to the partition of its
hash, packed; there counts are summed and each text's share of its log score is sent back to its block of texts. Both
steps grow with the corpus; no table of all words is ever in one place, and there are so many partitions that each has a
bounded share of the text.

Cases: null or empty text: one token, the end. No training texts: every count is 0, N and V are 0, and the model is the
uniform one. Very long texts are read whole; for encoding they are cut where a blank stands between two words, which
changes no id, and only where there is none in ``CHUNK / 2`` characters (a long run of blanks, say) after ``CHUNK``.
Ties of counts in the order of classes: the smaller id. Repeated rows: each counts and has its result. Other columns do
not matter.
"""

from __future__ import annotations

import base64
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .language_id import texts_of
from .lm_graph import Run, load, scoring, training
from .words import rows_of_words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIM, HALF, CLASSES, SHARED = 16, 16, 128, 32
ROUNDS, BATCH, SHARDS = 2, 64, 8
DENSE = ("emb", "pos", "q", "k", "v", "o", "u")
END_WORD = np.uint64(0xE4D0E4D0E4D0E4D1)
FLUSH = 1 << 19
CHUNK = 1 << 16
#: Bytes of text whose words one task is to count.
COUNT_BYTES = 64 << 20
Batches = Iterator[pa.RecordBatch]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict = {}


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def chunks(text: str) -> Iterator[str]:
    """The text in pieces of at most ``CHUNK`` characters."""
    at = 0
    while len(text) - at > CHUNK:
        # one character more on either side, so that the blank's neighbours are seen
        found = [m.start() for m in _BETWEEN.finditer(text, at + CHUNK // 2, at + CHUNK + 1)]
        cut = found[-1] if found else at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


def subwords(text: str | None, ranks: dict[bytes, int]) -> np.ndarray:
    """Ids of a text after lower-casing A-Z, and the end id (the number of ranks)."""
    key = id(ranks)
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    low = (text or "").encode("utf-8", "replace").translate(_LOWER).decode()
    ids = [i for part in chunks(low) for i in _ENCODERS[key].encode_ordinary(part)] if len(low) > CHUNK else _ENCODERS[key].encode_ordinary(low)
    return np.append(np.asarray(ids, np.int64), len(ranks))


# --- model -----------------------------------------------------------------------------------------------------------


def make_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log10 p(id | class)) from counts of all ids."""
    weight = counts + 0.5
    order = np.argsort(-counts, kind="stable")
    own = min(CLASSES - SHARED, len(order))
    cls = np.empty(len(counts), np.int64)
    cls[order[:own]] = np.arange(own)
    rest = order[own:]
    if len(rest):
        mass = np.cumsum(weight[rest]) / weight[rest].sum()
        cls[rest] = own + np.minimum((mass * SHARED).astype(np.int64), SHARED - 1)
    total = np.bincount(cls, weight, minlength=CLASSES)
    return cls, np.log10(weight / total[cls])


def windows(lengths: np.ndarray, flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs (w, 2 HALF), targets (w, HALF), text of each window) of texts of so many ids, one behind the other.

    ``size`` (one past the largest id) opens a text, ``size + 1`` is before it; a target of -1 is none.
    """
    lengths = np.asarray(lengths, np.int64)
    count = -(-lengths // HALF)
    first = np.concatenate([[0], np.cumsum(count + 1)])[:-1] * HALF  # of each text in the line of inputs
    line = np.full(int((count + 1).sum()) * HALF, size + 1, np.int32)
    line[first + HALF] = size
    target = np.full(int(count.sum()) * HALF, -1, np.int32)
    ends, begins = np.cumsum(lengths), (np.cumsum(count) - count) * HALF
    for at, to, a, b in zip((first + HALF + 1).tolist(), begins.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
        line[at : at + b - a - 1] = flat[a : b - 1]
        target[to : to + b - a] = flat[a:b]
    rows = line.reshape(-1, HALF)
    keep = np.ones(len(rows), bool)
    keep[np.cumsum(count + 1) - 1] = False
    at = np.flatnonzero(keep)
    return np.concatenate([rows[at], rows[at + 1]], axis=1), target.reshape(-1, HALF), np.repeat(np.arange(len(lengths)), count)


_MASK = np.where(np.arange(2 * HALF)[None] <= np.arange(HALF)[:, None] + HALF, 0, -1e9).astype(np.float32)


def new_model(cls: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Untrained weights; ``cls``: the class of each id. ``own`` are the ids' embeddings, besides those of their classes."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    m = {"emb": draw(CLASSES + 2, DIM), "pos": draw(2 * HALF, DIM), "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM), "o": draw(DIM, DIM), "u": draw(DIM, CLASSES) * 0}
    m |= {"own": np.zeros((len(cls) + 2, DIM), np.float32), "b": np.zeros(CLASSES, np.float32), "bigram": np.zeros((CLASSES + 2, CLASSES), np.float32)}
    return m | {"class": np.append(cls, [CLASSES, CLASSES + 1]).astype(np.int64)}


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays; a product with ones is several times as fast as ``sum``."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def forward(m: dict, inputs: np.ndarray) -> dict:
    """Batched masked attention; logits for the second half of each window."""
    before = inputs == len(m["class"]) - 1
    classes = m["class"].take(inputs)
    x = m["emb"].take(classes, axis=0)
    x += m["own"].take(inputs, axis=0)
    x += m["pos"]
    late = x[:, HALF:]
    q = (late.reshape(-1, DIM) @ m["q"]).reshape(late.shape)
    k, v = ((x.reshape(-1, DIM) @ m[w]).reshape(x.shape) for w in "kv")
    s = (q * np.float32(DIM**-0.5)) @ k.transpose(0, 2, 1)
    s += _MASK
    s[before[:, 0], :, :HALF] = -1e9
    np.minimum(s, s.dtype.type(60), out=s)
    a = np.exp(s, out=s)
    a /= _sums(a)
    c = a @ v
    h = late + c @ m["o"]
    z = (m["bigram"] + m["b"]).take(classes[:, HALF:].reshape(-1), axis=0)
    z += h.reshape(-1, DIM) @ m["u"]
    return {"x": x, "classes": classes, "q": q, "k": k, "v": v, "a": a, "c": c, "h": h, "z": np.clip(z, -60, 60, out=z)}


def products(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Projections multiplied out, so that positions are compared and mixed as they are: (q and k, v and o)."""
    return (m["q"] @ m["k"].T) * np.float32(DIM**-0.5), m["v"] @ m["o"]


def graph_of(m: dict) -> Run | None:
    """What scores windows; none without the runtime."""
    qk, vo = products(m)
    return load(scoring({"x": m["emb"][m["class"]] + m["own"], "pos": m["pos"], "qk": qk, "vo": vo, "u": m["u"], "last": m["bigram"] + m["b"]}, _MASK))


def tables_of(m: dict) -> dict[str, np.ndarray]:
    """What scoring needs, multiplied out: projections of ids and of positions, and logits of the last class alone."""
    x, late = m["emb"][m["class"]] + m["own"], m["pos"][HALF:]
    scale = np.float32(DIM**-0.5)
    return {
        "x": x, "late": late, "q": (x @ m["q"]) * scale, "q_pos": (late @ m["q"]) * scale,
        "k": x @ m["k"], "k_pos": m["pos"] @ m["k"],
        "v": x @ m["v"] @ m["o"], "v_pos": m["pos"] @ m["v"] @ m["o"],
        "u": m["u"], "last": m["bigram"] + m["b"], "class": m["class"],
    }


def log10_of(t: dict, inputs: np.ndarray, targets: np.ndarray, step: int = 128, run: Run | None = None) -> np.ndarray:
    """log10 p(class) of each target, 0 where there is none; as ``forward``, in pieces that stay in the cache. ``t``: of ``tables_of``; ``run``: of ``graph_of``."""
    out, opens = np.zeros(targets.size), len(t["class"]) - 1
    for at in range(0, len(inputs) if run else 0, BATCH):
        x, y = inputs[at : at + BATCH], targets[at : at + BATCH].reshape(-1)
        feeds = {"ids": np.ascontiguousarray(x, np.int32), "opens": (x[:, 0] == opens).astype(np.int64), "classes": t["class"].take(x[:, HALF:].reshape(-1)), "goal": t["class"].take(np.maximum(y, 0))[:, None]}
        out[at * HALF : at * HALF + len(y)] = np.where(y >= 0, run(feeds)[0][:, 0], 0)
    if run:
        return out / np.log(10)
    for at in range(0, len(inputs), step):
        x, y = inputs[at : at + step], targets[at : at + step].reshape(-1)
        late = x[:, HALF:]
        q, k, v = t["q"].take(late, axis=0), t["k"].take(x, axis=0), t["v"].take(x, axis=0)
        q += t["q_pos"]
        k += t["k_pos"]
        v += t["v_pos"]
        s = q @ k.transpose(0, 2, 1)
        s += _MASK
        s[x[:, 0] == opens, :, :HALF] = -1e9
        np.minimum(s, s.dtype.type(60), out=s)
        np.exp(s, out=s)
        s /= _sums(s)
        h = s @ v
        h += t["x"].take(late, axis=0)
        h += t["late"]
        z = h.reshape(-1, DIM) @ t["u"]
        z += t["last"].take(t["class"].take(late.reshape(-1)), axis=0)
        np.clip(z, -60, 60, out=z)
        mine = z[np.arange(len(y)), t["class"][np.maximum(y, 0)]]
        np.exp(z, out=z)
        out[at * HALF : at * HALF + len(y)] = np.where(y >= 0, mine - np.log(_sums(z)[:, 0]), 0)
    return out / np.log(10)


def _row_sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of ``index``, in some order, the sums of their ``rows``)."""
    at, width = np.arange(len(index)), rows.shape[1]
    seat = np.empty(int(index.max()) + 1, np.int64)
    seat[index] = at  # one of the places of each number
    found = index[seat.take(index) == at]
    seat[found] = np.arange(len(found))
    place = seat.take(index)
    sums = np.bincount((place[:, None] * width + np.arange(width)).reshape(-1), rows.reshape(-1), minlength=len(found) * width)
    return found, sums.reshape(-1, width).astype(rows.dtype)


def _filled(found: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((n, found[1].shape[1]), found[1].dtype)
    out[found[0]] = found[1]
    return out


def gradients(m: dict, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood (natural) and its gradients; that of ``own`` as (ids, rows)."""
    f = forward(m, inputs)
    live = targets.reshape(-1) >= 0
    n = max(1, int(live.sum()))
    at = np.arange(len(live)), m["class"].take(np.maximum(targets.reshape(-1), 0))
    p = np.exp(f["z"], out=f["z"])
    whole = _sums(p)
    loss = -np.log(p[at][live] / whole[live, 0] + 1e-30).sum() / n
    p *= live[:, None] / (whole * whole.dtype.type(n))  # no targets: 0
    p[at] -= live / whole.dtype.type(n)
    flat = lambda x: x.reshape(-1, DIM)
    dz, h = p, flat(f["h"])
    g: dict = {"u": h.T @ dz}
    dh = (dz @ m["u"].T).reshape(f["h"].shape)
    g["o"] = flat(f["c"]).T @ flat(dh)
    dc = dh @ m["o"].T
    da = dc @ f["v"].transpose(0, 2, 1)
    dv = f["a"].transpose(0, 2, 1) @ dc
    da -= _sums(da * f["a"])
    da *= f["a"]
    dq, dk = da @ f["k"], da.transpose(0, 2, 1) @ f["q"]
    dq *= np.float32(DIM**-0.5)
    dk *= np.float32(DIM**-0.5)
    late = f["x"][:, HALF:]
    g["q"] = flat(late).T @ flat(dq)
    g["k"], g["v"] = flat(f["x"]).T @ flat(dk), flat(f["x"]).T @ flat(dv)
    dx = (flat(dk) @ m["k"].T + flat(dv) @ m["v"].T).reshape(f["x"].shape)
    dx[:, HALF:] += dh + dq @ m["q"].T
    g["pos"] = dx.sum(axis=0)
    ids, rows = _row_sums(inputs.reshape(-1), flat(dx))
    g["own"] = ids, rows
    g["emb"] = _filled(_row_sums(m["class"][ids], rows), CLASSES + 2)
    return float(loss), g


class Adam:
    """``m`` and its moments. The logits of the last class are counts and stay; of ``own`` only rows with a gradient move."""

    def __init__(self, m: dict):
        self.m, self.step = m | {k: m[k].copy() for k in (*DENSE, "own")}, 0
        self.one, self.two = ({k: np.zeros_like(m[k]) for k in (*DENSE, "own")} for _ in range(2))
        self.times = np.zeros(len(m["own"]), np.int64)

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, rate: float) -> None:
        self.step += 1
        _, g = gradients(self.m, inputs, targets)
        self.times[g["own"][0]] += 1
        for k in (*DENSE, "own"):
            at, v = g[k] if k == "own" else (slice(None), g[k])
            one = self.one[k][at] = 0.9 * self.one[k][at] + 0.1 * v
            two = self.two[k][at] = 0.99 * self.two[k][at] + 0.01 * v * v
            self.m[k][at] -= rate * (one / (1 - 0.9**self.step)) / (np.sqrt(two / (1 - 0.99**self.step)) + 1e-8)


class GraphAdam:
    """``Adam`` on gradients from a graph (``lm_graph.training``). Moments are kept as sums of powers of the gradients, without (1 - decay)."""

    def __init__(self, m: dict, run: Run):
        self.run, self.step, self.given = run, 0, m
        self.line, cuts = np.concatenate([m[k].reshape(-1) for k in DENSE]), np.cumsum([m[k].size for k in DENSE])[:-1]
        self.dense = {k: v.reshape(m[k].shape) for k, v in zip(DENSE, np.split(self.line, cuts), strict=True)}
        self.one, self.two = np.zeros_like(self.line), np.zeros_like(self.line)
        self.own = [m["own"].copy(), np.zeros_like(m["own"]), np.zeros_like(m["own"])]  # and moments
        self.times, self.seat = np.zeros(len(m["own"]), np.int64), np.empty(len(m["own"]), np.int64)

    @property
    def m(self) -> dict:
        return self.given | self.dense | {"own": self.own[0]}

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, rate: float) -> None:
        self.step += 1
        m, cls, goal = self.dense, self.given["class"], targets.reshape(-1)
        index, at = inputs.reshape(-1), np.arange(inputs.size)
        self.seat[index] = at  # one of the places of each id
        ids = index[self.seat.take(index) == at]
        self.seat[ids] = np.arange(len(ids))
        kinds, (own, one, two) = cls.take(ids), (a.take(ids, axis=0) for a in self.own)
        live = goal >= 0
        feeds = {"rows": m["emb"].take(kinds, axis=0) + own, "kinds": kinds[:, None], "place": self.seat.take(inputs)}
        feeds |= {"opens": (inputs[:, 0] == len(cls) - 1).astype(np.int64), "classes": cls.take(inputs[:, HALF:].reshape(-1)), "goal": cls.take(np.maximum(goal, 0))[:, None]}
        feeds |= {"each": (live * np.float32(1 / max(1, np.count_nonzero(live)))).repeat(DIM).reshape(-1, DIM), "pos": m["pos"], "u": m["u"]}
        feeds |= dict(zip(("qk", "vo"), products(m), strict=True))
        rows, emb, pos, qk, vo, u = self.run(feeds)
        qk *= np.float32(DIM**-0.5)
        g = {"emb": emb, "pos": pos, "q": qk @ m["k"], "k": qk.T @ m["q"], "v": vo @ m["o"].T, "o": m["v"].T @ vo, "u": u}
        self.line -= self.change(self.one, self.two, np.concatenate([g[k].reshape(-1) for k in DENSE]), rate)
        own -= self.change(one, two, rows, rate)
        for kept, now in zip(self.own, (own, one, two), strict=True):
            kept[ids] = now
        self.times[ids] += 1

    def change(self, one: np.ndarray, two: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        """What a step takes off; moves the moments."""
        one *= 0.9
        one += g
        two *= 0.99
        two += g * g
        root = (1 - 0.99**self.step) ** 0.5
        below = np.sqrt(two)
        below += 1e-7 * root
        out = one / below
        out *= rate * root / (1 - 0.9**self.step)
        return out


def adam_of(m: dict) -> Adam | GraphAdam:
    run = load(training(m["bigram"] + m["b"], _MASK, DIM))
    return GraphAdam(m, run) if run else Adam(m)


def train(m: dict, inputs: np.ndarray, targets: np.ndarray, steps: int = 600, batch: int = BATCH, rate: float = 0.01, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    adam = adam_of(m)
    for step in range(steps):
        rows = rng.integers(0, len(inputs), batch)
        adam(inputs[rows], targets[rows], rate * (1 - step / steps))
    return adam.m


def last_logits(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """``b`` and ``bigram`` from counts (CLASSES + 2, CLASSES) of classes by the class before; rows are smoothed by the whole."""
    whole = pairs.sum(axis=0) + 0.5
    whole = whole / whole.sum()
    row = (pairs + 8 * whole) / (pairs.sum(axis=1, keepdims=True) + 8)
    return {"b": np.log(whole).astype(np.float32), "bigram": np.log(row / whole).astype(np.float32)}


# --- texts as ids and postings ---------------------------------------------------------------------------------------

NAMES = ["target", "block", "packed"]
CODED = "target int, block long, packed binary"


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _batch(rows: list[tuple[int, int, bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=NAMES)


def encode(docs: DataFrame, learn: Column, vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict]:
    """(a table of the texts of (doc_id, text), its settings), for ``fit`` and ``score``; ``learn``: what may be learned from.

    By block: target -1 with the texts' ``ids``, and for each target >= 0 the ``packed`` postings of the words that are dealt
    there; in columns of their own, so that what needs the ids alone reads nothing else.
    """
    spark = docs.sparkSession
    ranks = load_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast(ranks)
    kind = _kind(len(ranks) + 1)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    targets = max(partitions(spark), 16, size // COUNT_BYTES)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(True)).alias("learn"))

    def send(batches: Batches) -> Batches:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            data, offsets = texts_of(texts)
            learns = np.array(batch.column("learn").to_pylist(), bool)
            ids = batch.column("doc_id").to_pylist()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            first, size = 0, 0

            def flush(a: int, b: int, held: list = held, learns: np.ndarray = learns, ids: list = ids, texts: pa.Array = texts) -> pa.RecordBatch:
                words, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                words = np.concatenate([words, np.full(b - a, END_WORD)])
                rows = np.concatenate([rows, np.arange(b - a)])
                tokens = np.bincount(rows, minlength=b - a).astype(np.int64)
                order = np.lexsort((rows, words))
                words, rows = words[order], rows[order]
                new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])]))
                times = np.diff(np.append(new, len(words)))
                words, rows = words[new], rows[new]
                to = ((words >> np.uint64(40)) % np.uint64(targets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(targets + 1))
                out = []
                for t in range(targets):
                    part = order[cut[t] : cut[t + 1]]
                    if len(part):
                        w, start = np.unique(words[part], return_index=True)
                        sizes = np.diff(np.append(start, len(part))).astype(np.uint32)
                        coded = (rows[part] << 1 | learns[a:b][rows[part]]).astype(np.uint32)
                        out.append((t, block, np.array([len(w), len(part)], np.int64).tobytes() + w.tobytes() + sizes.tobytes() + coded.tobytes() + times[part].astype(np.uint32).tobytes()))
                found = [subwords(text, shared.value).astype(kind) for text in texts.slice(a, b - a).to_pylist()]
                head = [[x is None for x in ids[a:b]], [x or 0 for x in ids[a:b]], tokens, learns[a:b], [len(f) for f in found]]
                own = np.array([b - a], np.int64).tobytes() + b"".join(np.asarray(x, np.int64).tobytes() for x in head) + np.concatenate(found).tobytes()
                both = _batch([*out, (-1, block, None)])
                return both.append_column("ids", pa.array([None] * len(out) + [own], pa.binary()))

            for a, b, words, bounds, _, _ in rows_of_words(data, offsets):
                held.append((words, np.repeat(np.arange(a - first, b - first), np.diff(bounds))))
                size += len(words) + b - a
                if size > FLUSH or b == batch.num_rows:
                    yield flush(first, b)
                    block += 1
                    held.clear()
                    first, size = b, 0

    coded = materialize(source.mapInArrow(send, f"{CODED}, ids binary"), "lm-coded")
    shared.destroy()
    return coded, {"size": len(ranks) + 1, "targets": targets}


def _own(blob: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """((null, doc_id, tokens, learn, lengths) as rows, ids of the texts one behind the other)."""
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    return np.frombuffer(blob[8 : 8 + 40 * n], np.int64).reshape(5, n), np.frombuffer(blob[8 + 40 * n :], kind)


def _texts(coded: DataFrame) -> DataFrame:
    return coded.filter("ids is not null").select("target", "block", F.col("ids").alias("packed"))


def _training(batches: Batches, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, lengths, ids) of the texts to learn from."""
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
            head, flat = _own(blob.as_py(), kind)
            learn = head[3] > 0
            if learn.any():
                yield block, head[4][learn], flat[np.repeat(learn, head[4])]


# --- training --------------------------------------------------------------------------------------------------------


def _saved(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m)
    return out.getvalue()


def _draw(lengths: np.ndarray, flat: np.ndarray, size: int, block: int, seed: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose random number lies in [low, high): the same ones whenever a task is done again."""
    x, y, _ = windows(lengths, flat, size)
    chance = np.random.default_rng([seed, block]).random(len(x))
    take = (chance >= low) & (chance < high)
    return x[take], y[take]


def train_all(own: DataFrame, size: int, m: dict, share: float, rate: float = 0.004) -> tuple[dict, int]:
    """``m`` after ``ROUNDS`` rounds over a ``share`` of all windows, no window twice, and the number of subwords in them."""
    spark, kind = own.sparkSession, _kind(size)
    cuts = np.cumsum([m[k].size for k in DENSE])[:-1]
    seen = 0
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(m)
        lr, low, high = rate * (1 - turn / ROUNDS), share * turn / ROUNDS, share * (turn + 1) / ROUNDS

        def go(batches: Batches, now=now, lr: float = lr, low: float = low, high: float = high) -> Batches:  # noqa: ANN001
            adam, used, n = adam_of(now.value), 0, 0
            for block, lengths, flat in _training(batches, kind):
                x, y = _draw(lengths, flat, size, block, 3, low, high)
                order = np.random.default_rng(7).permutation(len(x))
                for at in range(0, len(x), BATCH):
                    rows = order[at : at + BATCH]
                    adam(x[rows], y[rows], lr)
                used, n = used + len(x), n + int((y >= 0).sum())
            if used:
                m = adam.m
                dense = np.concatenate([m[k].reshape(-1) for k in DENSE]).astype(np.float64) * used
                out = [(-1, 0, np.array([used, n], np.float64).tobytes() + dense.tobytes())]
                moved = np.flatnonzero(adam.times)
                for shard in range(SHARDS):
                    ids = moved[moved % SHARDS == shard].astype(np.int32)
                    times = adam.times[ids].astype(np.float32)
                    out.append((shard, 0, np.array([len(ids)], np.int64).tobytes() + ids.tobytes() + times.tobytes() + (m["own"][ids] * times[:, None]).tobytes()))
                yield _batch(out)

        def add(batches: Batches) -> Batches:
            dense, sums = None, None
            for batch in batches:
                for shard, blob in zip(batch.column("target").to_pylist(), batch.column("packed"), strict=True):
                    raw = blob.as_py()
                    if shard < 0:
                        part = np.frombuffer(raw, np.float64)
                        dense = part if dense is None else dense + part
                        continue
                    sums = np.zeros((size + 2, DIM + 1)) if sums is None else sums
                    n = int(np.frombuffer(raw[:8], np.int64)[0])
                    ids = np.frombuffer(raw[8 : 8 + 4 * n], np.int32)
                    sums[ids, DIM] += np.frombuffer(raw[8 + 4 * n : 8 + 8 * n], np.float32)
                    sums[ids, :DIM] += np.frombuffer(raw[8 + 8 * n :], np.float32).reshape(n, DIM)
            out = [] if dense is None else [(-1, 0, dense.tobytes())]
            if sums is not None:
                ids = np.flatnonzero(sums[:, DIM])
                out.append((0, 0, ids.astype(np.int32).tobytes() + (sums[ids, :DIM] / sums[ids, DIM:]).astype(np.float32).tobytes()))
            if out:
                yield _batch(out)

        moved = own.mapInArrow(go, CODED).repartition(SHARDS + 1, "target").mapInArrow(add, CODED).collect()  # the weights, once
        table = m["own"].copy()
        for r in moved:
            raw = bytes(r.packed)
            if r.target < 0:
                flat = np.frombuffer(raw, np.float64)
                m = m | {k: (v / flat[0]).reshape(m[k].shape).astype(np.float32) for k, v in zip(DENSE, np.split(flat[2:], cuts), strict=True)}
                seen += int(flat[1])
            else:
                n = len(raw) // (4 + 4 * DIM)
                table[np.frombuffer(raw[: 4 * n], np.int32)] = np.frombuffer(raw[4 * n :], np.float32).reshape(n, DIM)
        m = m | {"own": table}
        now.destroy()
    return m, seen


def fit(coded: tuple[DataFrame, dict], start_windows: int = 40_000, window_share: float = 1.0, steps: int = 600) -> dict:
    """The model from the training texts of ``encode``. ``trained``: subwords in the windows used after the first weights."""
    table, size = coded[0], coded[1]["size"]
    kind = _kind(size)
    own = _texts(table)

    def count(batches: Batches) -> Batches:
        total, n = np.zeros(size, np.int64), 0
        for _, lengths, flat in _training(batches, kind):
            total += np.bincount(flat, minlength=size)
            n += int((-(-lengths // HALF)).sum())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["id", "n"])

    counts, total = np.zeros(size, np.int64), 0
    for r in own.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        if r.id < 0:
            total = r.n
        else:
            counts[r.id] = r.n
    cls, share = make_classes(counts)
    model = new_model(cls)
    if not total:
        return {"model": model, "share": share, "size": size, "trained": 0}

    def pair(batches: Batches) -> Batches:
        total = np.zeros((CLASSES + 2) * CLASSES, np.int64)
        for _, lengths, flat in _training(batches, kind):
            line = cls[flat]
            before = np.append(CLASSES, line[:-1])
            before[np.cumsum(lengths) - lengths] = CLASSES
            total += np.bincount(before * CLASSES + line, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    pairs = np.zeros((CLASSES + 2) * CLASSES)
    for r in own.mapInArrow(pair, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        pairs[r.id] = r.n
    model |= last_logits(pairs.reshape(CLASSES + 2, CLASSES))
    rate = min(1.0, start_windows / total)

    def draw(batches: Batches) -> Batches:
        for block, lengths, flat in _training(batches, kind):
            x, y = _draw(lengths, flat, size, block, 2, 0, rate)
            yield _batch([(0, block, x.tobytes() + y.tobytes())])

    def begin(batches: Batches) -> Batches:
        raw = [np.frombuffer(blob.as_py(), np.int32) for batch in batches for blob in batch.column("packed")]
        x = np.concatenate([r[: len(r) * 2 // 3].reshape(-1, 2 * HALF) for r in raw]) if raw else np.zeros((0, 2 * HALF), np.int32)
        y = np.concatenate([r[len(r) * 2 // 3 :].reshape(-1, HALF) for r in raw]) if raw else np.zeros((0, HALF), np.int32)
        if len(x):
            yield _batch([(0, 0, _saved(train(model, x, y, steps)))])

    if start_windows and steps:
        got = own.mapInArrow(draw, CODED).repartition(1).sortWithinPartitions("block").mapInArrow(begin, CODED).collect()  # about ``start_windows`` windows; one model
        if got:
            model = dict(np.load(io.BytesIO(bytes(got[0].packed))))
    model, trained = train_all(own, size, model, window_share)
    return {"model": model, "share": share, "size": size, "trained": trained}


# --- scores ----------------------------------------------------------------------------------------------------------


def score_ids(lengths: np.ndarray, flat: np.ndarray, tables: dict, share: np.ndarray, run: Run | None = None) -> np.ndarray:
    """log10 probability of each text of so many ids, its end included."""
    x, y, text = windows(lengths, flat, len(tables["class"]) - 2)
    out = np.bincount(text, log10_of(tables, x, y, run=run).reshape(-1, HALF).sum(axis=1), minlength=len(lengths))
    return out + np.bincount(np.repeat(np.arange(len(lengths)), lengths), share[flat], minlength=len(lengths))


def score_texts(texts: list[str | None], fitted: dict, ranks: dict) -> np.ndarray:
    """log10 probability of each whole text, its end included."""
    found = [subwords(text, ranks) for text in texts]
    return score_ids(np.array([len(f) for f in found]), np.concatenate(found), tables_of(fitted["model"]), fitted["share"])


def score(coded: tuple[DataFrame, dict], fitted: dict) -> DataFrame:
    """One row per document of ``encode``: doc_id, held_out, n_tokens, n_known, train_tokens, train_words, base_score, score."""
    sent, targets, kind = coded[0], coded[1]["targets"], _kind(fitted["size"])
    light = sent.sparkSession.sparkContext.broadcast((fitted["model"], fitted["share"]))

    def rate(batches: Batches) -> Batches:
        tables, run = tables_of(light.value[0]), graph_of(light.value[0])
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
                head, flat = _own(blob.as_py(), kind)
                yield _batch([(-1, block, head[:4].tobytes() + score_ids(head[4], flat, tables, light.value[1], run).tobytes())])

    scored = materialize(_texts(sent).mapInArrow(rate, CODED), "lm-scored")
    light.destroy()

    def meet(batches: Batches) -> Batches:
        for target, blobs in _by_target(batches):
            parts = []
            for block, blob in blobs:
                n, m = np.frombuffer(blob[:16], np.int64)
                at = 16 + 8 * n
                rest = np.frombuffer(blob[at:], np.uint32)
                parts.append((block, np.frombuffer(blob[16:at], np.uint64), rest[:n], rest[n : n + m], rest[n + m :]))
            vocabulary = np.unique(np.concatenate([p[1] for p in parts]))
            counts = np.zeros(len(vocabulary), np.int64)
            places = []
            for _, words, sizes, coded, times in parts:
                place = np.repeat(np.searchsorted(vocabulary, words).astype(np.int32), sizes)
                places.append(place)
                counts += np.bincount(place, times * (coded & 1), minlength=len(counts)).astype(np.int64)
            logs = np.log10(counts + 0.5)
            for (block, _, _, coded, times), place in zip(parts, places, strict=True):
                row = (coded >> 1).astype(np.int64)
                total = np.bincount(row, logs[place] * times)
                known = np.bincount(row, (counts[place] > 0) * times)
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([block], pa.int64()), pa.array([total.tobytes() + known.astype(np.float64).tobytes()], pa.binary())], names=NAMES)
            tail = np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([0], pa.int64()), pa.array([tail], pa.binary())], names=NAMES)

    shares = sent.filter("target >= 0").select(*NAMES).repartition(targets, "target").sortWithinPartitions("target").mapInArrow(meet, CODED)
    shares = materialize(shares, "lm-shares")
    sums = shares.filter("target = -2").mapInArrow(_totals, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = int(sums[0] or 0), int(sums[1] or 0)
    off = np.log10(tokens + 0.5 * (distinct + 1))

    def finish(batches: Batches) -> Batches:
        own: dict[int, bytes] = {}
        total: dict[int, list[bytes]] = {}
        for batch in batches:
            for target, block, blob in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                if target == -1:
                    own[block] = blob
                else:
                    total.setdefault(block, []).append(blob)
        for block in sorted(own):
            n = len(own[block]) // 40
            null, ids, count, learn, _ = np.frombuffer(own[block], np.int64).reshape(5, n)
            scores = np.frombuffer(own[block], np.float64).reshape(5, n)[4]
            raw, known = np.zeros(n), np.zeros(n)
            for blob in total.get(block, []):
                a, b = np.frombuffer(blob, np.float64).reshape(2, -1)
                raw[: len(a)] += a
                known[: len(b)] += b
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(learn == 0), pa.array(count), pa.array(known.astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(np.full(n, distinct)), pa.array(raw - count * off), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "train_words", "base_score", "score"])

    both = scored.unionByName(shares.filter("target >= 0")).repartition(targets, "block").sortWithinPartitions("block", "target")
    return both.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, train_words long, base_score double, score double")


def _by_target(batches: Batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(target, its (block, blob)); batches are sorted by target."""
    current, held = -1, []
    for batch in batches:
        for target, block, blob in zip(batch.column("target").to_pylist(), batch.column("block").to_pylist(), batch.column("packed"), strict=True):
            if target != current and held:
                yield current, held
                held = []
            current = target
            held.append((block, blob.as_py()))
    if held:
        yield current, held


def _totals(batches: Batches) -> Batches:
    for batch in batches:
        both = [np.frombuffer(x, np.int64) for x in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(b[0]) for b in both], pa.int64()), pa.array([int(b[1]) for b in both], pa.int64())], names=["tokens", "words"])
