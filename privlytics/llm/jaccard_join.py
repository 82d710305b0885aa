"""N-gram Jaccard join with signature trees.

Documents link when the Jaccard similarity of their sets of word shingles is at least ``num / den`` (exact integers);
the result is each document's component under links.

1. Equal sets become one class, told apart by two 64-bit sums over the set. Along the way a table of ``2**bits`` counters,
   chosen by the size of the texts (about 32 shingles a counter, at most 2**25), gathers how often shingles occur: a global
   order from rare to frequent. Counters are shared by shingles, which only makes some look more frequent than they are.
2. Of two sets that link the smaller has a shingle among its first ``n - ceil(2 t n / (1 + t)) + 1`` in that order (index)
   which is among the first ``n - ceil(t n) + 1`` of the larger (probe), and their sizes are at most one step of a
   logarithmic scale apart. Tasks send these shingles with class and step, packed, to the partition of the shingle's
   hash; there are so many partitions that each gets a bounded number of bytes. For each shingle and step, the classes of
   this step and the next make a region if one of this step has the shingle for an index; the smallest is the region's
   leader, and (leader, step, member) are sent on: all linked pairs lie in a common region. Shingles with counts far over
   the mean are dealt by rows instead, with their leader found by partial minimums.
3. Regions are cut into blocks of ``block`` members. In regions
   of one block a signature tree over bitmaps alone, a few bytes a member, keeps those members that may link with another;
   only their sets are fetched. Bitmaps and sets are made where the texts are read and go straight to their regions. In
   each block, with the leader, a signature tree is built over the
   members' sets: members sorted by size, nodes with OR-combined bitmaps of token bits and size ranges. Dual traversal
   leaves out node pairs whose maximum possible overlap is too small or whose members are connected already; pairs at
   the leaves are verified on the exact sets. Only links that join two components are sent on.
4. In regions of more than one block, members that are not yet connected with the leader meet all other blocks, tree
   against tree. So no link between different sets is lost, and connected copies are never compared with each other.
5. Components by repeated minimum over neighbours and pointer jumps, on written tables.

A large group of near copies costs in step 4 the product of unconnected members and group, in blocks, pruned by the trees.

Cases: null or empty text: n_shingles 0, linked with nothing. Fewer words than a shingle: the whole sequence is one.
Repeated rows: one component if they have words. Very long texts are one set like others. Null ids: such rows link like others, but give no component its name;
a component of null ids alone has a null name. Only id and text are read, so other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, partitions, tidy
from .language_id import texts_of
from .words import mix, shingle_sets

HOT = 1 << 18
BLOCK = 512
FLUSH = 1 << 22
#: Bytes of packed prefixes that one task is to meet.
MEET_BYTES = 48 << 20
Pairs = Iterator[pa.RecordBatch]


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _index_length(n: int, num: int, den: int) -> int:
    return n - -(-2 * num * n // (num + den)) + 1


def _step_of(n: int, num: int, den: int) -> int:
    """Sizes within den / num of each other are at most one step apart; below 128."""
    return int(np.log(n) / max(np.log(den / num) * (1 + 1e-9), 0.2))


def _class_key(found: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as signed integers."""
    with np.errstate(over="ignore"):
        return int(mix(found).sum(dtype=np.uint64).astype(np.int64)), int(mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64))


def _count(counters: np.ndarray, pending: list[np.ndarray]) -> None:
    found, times = np.unique(np.concatenate(pending), return_counts=True)
    counters[found.astype(np.int64)] += times.astype(np.uint32)


def _squeeze(counters: np.ndarray) -> bytes:
    """Counters as bytes, with those over 254 behind them."""
    large = np.flatnonzero(counters > 254)
    low = np.minimum(counters, 255).astype(np.uint8)
    return zlib.compress(low.tobytes() + large.astype(np.uint32).tobytes() + counters[large].tobytes(), 1)


def _unsqueeze(blob: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    large = np.frombuffer(raw[n:], np.uint32).reshape(2, -1)
    out[large[0]] = large[1]
    return out


def _sets(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(doc_id, row, n, k1, k2) for each document, and (part, counts) with the task's counters."""

    def run(batches: Pairs) -> Pairs:
        counters = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            n, k1, k2, pending, held = [], [], [], [], 0
            for found in shingle_sets(data, offsets, shingle):
                a, b = _class_key(found) if len(found) else (0, 0)
                n.append(len(found)), k1.append(a), k2.append(b)
                pending.append(found & np.uint64((1 << bits) - 1))
                held += len(found)
                if held > FLUSH:
                    _count(counters, pending)
                    pending, held = [], 0
            if held:
                _count(counters, pending)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "row", "n", "k1", "k2", "part", "counts"])
        if counters.any():
            parts = counters.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(64, batch.column("doc_id").type), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int32()), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int64()), pa.array(range(64), pa.int32()), pa.array([_squeeze(p) for p in parts], pa.binary())], names=["doc_id", "row", "n", "k1", "k2", "part", "counts"])

    return docs.mapInArrow(tidy(run), "doc_id long, row long, n int, k1 long, k2 long, part int, counts binary")


def _sketch(tables: DataFrame, bits: int) -> np.ndarray:
    """The summed counters, ``2**bits`` numbers; summed by part on the executors."""

    def add(batches: Pairs) -> Pairs:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + _unsqueeze(blob, (1 << bits) // 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_squeeze(np.minimum(v, 2**32 - 1).astype(np.uint32)) for v in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((64, (1 << bits) // 64), np.uint32)
    for r in tables.repartition(8, "part").mapInArrow(tidy(add), "part int, counts binary").collect():
        out[r.part] = _unsqueeze(bytes(r.counts), (1 << bits) // 64)
    return out.reshape(-1)


def _pack(to: np.ndarray, token: np.ndarray, key: np.ndarray, step: np.ndarray) -> list[tuple[int, bytes]]:
    """By target: runs of one class as (class, step, length), then all tokens; the lowest bit of a token says index."""
    order = np.argsort(to, kind="stable")
    token, key, step, to = token[order], key[order], step[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        run = a + np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
        sizes = np.diff(np.append(run, b)).astype(np.uint32)
        out.append((int(to[a]), np.array([len(run)], np.int64).tobytes() + key[run].tobytes() + sizes.tobytes() + step[run].tobytes() + token[a:b].tobytes()))
    return out


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, class, step, index) of packed prefixes."""
    tokens, keys, steps = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob[:8], np.int64)[0])
        sizes = np.frombuffer(blob[8 + 8 * n : 8 + 12 * n], np.uint32)
        keys.append(np.repeat(np.frombuffer(blob[8 : 8 + 8 * n], np.int64), sizes))
        steps.append(np.repeat(np.frombuffer(blob[8 + 12 * n : 8 + 13 * n], np.uint8), sizes))
        tokens.append(np.frombuffer(blob[8 + 13 * n :], np.uint64))
    token = np.concatenate(tokens)
    return token & ~np.uint64(1), np.concatenate(keys), np.concatenate(steps), (token & np.uint64(1)).astype(bool)


def _meetings(token: np.ndarray, key: np.ndarray, step: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (leader, step, member) of the postings of some tokens."""
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])  # equal classes come from several tasks
    order, token, key = order[new], token[new], key[new]
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(at, len(token)))
    group, several = np.repeat(np.arange(len(at)), count), np.repeat(count > 1, count)
    order, key, group = order[several], key[several], group[several]
    step, index = step[order].astype(np.int64), index[order]
    # each posting is in the region of its step, and in that of the step below
    n = len(key)
    key, region = np.concatenate([key, key]), np.concatenate([group * 256 + step + 1, group * 256 + step])
    small = np.concatenate([index, np.zeros(n, bool)])
    order = np.lexsort((key, region))
    key, region, small = key[order], region[order], small[order]
    at = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])[: len(region)])
    count = np.diff(np.append(at, len(region)))
    ok = np.repeat((count > 1) & (np.add.reduceat(small, at, dtype=np.int64) > 0 if n else False), count)
    leader, step, key = np.repeat(key[at], count)[ok], region[ok] % 256 - 1, key[ok]
    order = np.lexsort((key, step, leader))
    leader, step, key = leader[order], step[order], key[order]
    new = np.concatenate([[True], (leader[1:] != leader[:-1]) | (step[1:] != step[:-1]) | (key[1:] != key[:-1])])[: len(key)]
    return leader[new], step[new], key[new]


def _regions(docs: DataFrame, counts: np.ndarray, total: int, shingle: int, num: int, den: int, hot: int) -> DataFrame:
    """Distinct (region, member, lead) of classes, the leader included: every linked pair of classes lies in a region.

    ``total``: shingles of all sets. A counter is hot if it stands ``hot`` over the mean of all.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)  # 2**bits numbers
    often_from = hot + int(counts.mean())
    targets = max(partitions(spark), 16, total * (den - num) // den * 11 // MEET_BYTES)

    def send(batches: Pairs) -> Pairs:
        counts = shared.value
        low = np.uint64(len(counts) - 1)
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        keys: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, times = np.concatenate(tokens), [k[2] for k in keys]
            key, step = np.repeat(np.array([k[0] for k in keys], np.int64), times), np.repeat(np.array([k[1] for k in keys], np.uint8), times)
            bare = token & ~np.uint64(1)
            to = (bare >> np.uint64(40)) % np.uint64(targets)
            # dealt by the bare token, so that both of its forms are hot or not
            often = np.maximum(counts[bare & low], counts[(bare | np.uint64(1)) & low]) > often_from
            to = np.where(often, np.uint64(targets) + mix(bare ^ key.view(np.uint64)) % np.uint64(targets), to).astype(np.int64)
            out = _pack(to, token, key, step)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["target", "packed"])

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for found in shingle_sets(data, offsets, shingle):
                if not len(found):
                    continue
                key = _class_key(found)[0]
                if key in seen:  # copies in this task say nothing new
                    continue
                seen.add(key)
                n = len(found)
                k = _prefix_length(n, num, den)
                often = counts[found & low]
                if k < n:
                    limit = np.partition(often, k - 1)[k - 1]
                    less, equal = often < limit, np.flatnonzero(often == limit)  # sets are sorted by hash
                    less[equal[: k - int(less.sum())]] = True
                    found, often = found[less], often[less]
                first = found & ~np.uint64(1)
                first[np.argsort(often, kind="stable")[: _index_length(n, num, den)]] |= np.uint64(1)
                tokens.append(first)
                keys.append((key, _step_of(n, num, den), len(first)))
                held += len(first)
                if held > FLUSH:
                    yield from flush()
                    tokens.clear(), keys.clear()
                    held = 0
        if held:
            yield from flush()

    def meet(batches: Pairs) -> Pairs:
        for blobs in _by_target(batches):
            leader, step, member = _meetings(*_unpack(blobs))
            for a in range(0, len(leader), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(leader[part]), pa.array(step[part], pa.int32()), pa.array(member[part])], names=["leader", "step", "member"])

    def rows(batches: Pairs) -> Pairs:
        for batch in batches:
            for blob in batch.column("packed").to_pylist():
                token, key, step, index = _unpack([blob])
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key), pa.array(step, pa.int32()), pa.array(index)], names=["token", "member", "own", "index"])

    any_hot = bool((counts > often_from).any())
    sent = docs.mapInArrow(tidy(send), "target int, packed binary")
    sent = materialize(sent, "jaccard-prefixes") if any_hot else sent
    common = sent.filter(F.col("target") < targets) if any_hot else sent
    pairs = common.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(tidy(meet), "leader long, step int, member long")
    if any_hot:
        each = sent.filter(F.col("target") >= targets).mapInArrow(tidy(rows), "token long, member long, own int, index boolean")
        each = each.withColumn("step", F.explode(F.array(F.col("own"), F.col("own") - 1)))
        each = materialize(each.withColumn("small", F.col("index") & (F.col("own") == F.col("step"))), "jaccard-hot")
        leaders = each.groupBy("token", "step").agg(F.min("member").alias("leader"), F.max("member").alias("last"), F.max("small").alias("any"))
        leaders = materialize(leaders.filter("leader < last and any").select("token", "step", "leader"), "jaccard-leaders")
        pairs = pairs.unionByName(each.join(leaders, ["token", "step"]).select("leader", "step", "member"))
    found = pairs.groupBy("leader", "step", "member").agg(F.lit(1).alias("one"))
    out = materialize(found.select(F.xxhash64("leader", "step").alias("region"), "member", (F.col("leader") == F.col("member")).alias("lead")), "jaccard-regions")
    shared.destroy()
    return out


def _by_target(batches: Pairs) -> Iterator[list[bytes]]:
    """The blobs of each target; batches are sorted by target."""
    current, held = None, []
    for batch in batches:
        for target, blob in zip(batch.column("target").to_pylist(), batch.column("packed"), strict=True):
            if target != current and held:
                yield held
                held = []
            current = target
            held.append(blob.as_py())
    if held:
        yield held


# --- signature trees -------------------------------------------------------------------------------------------------


class SignatureTree:
    """Members sorted by size; level 0 are the members, each node above holds up to ``fan`` of the level below."""

    def __init__(self, sizes: list[int], maps: np.ndarray, excess: np.ndarray, fan: int = 8):
        """``maps``: bitmaps as rows of 64-bit numbers; ``excess``: at least each one's tokens that share a bit with another."""
        self.order = np.argsort(np.array(sizes, np.int64), kind="stable")
        size = np.array(sizes, np.int64)[self.order]
        self.levels = [(maps[self.order], size, size, excess[self.order])]
        self.fan = fan
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, extra = self.levels[-1]
            at = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at)))


def signature(found: np.ndarray, width: int) -> np.ndarray:
    """Bitmap of a set, ``width`` bits (a power of 2, 64 at least) as 64-bit numbers."""
    bits = np.zeros(width, np.uint8)
    bits[(mix(found) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def _width(n: int) -> int:
    return min(1 << 15, 1 << max(6, int(2 * n).bit_length()))


def _tree(sizes: list[int], maps: list[np.ndarray]) -> SignatureTree:
    """Of bitmaps of any widths: narrow ones are repeated up to the widest, which adds bits but loses none."""
    words = max(len(m) for m in maps)
    excess = np.array([n - int(np.bitwise_count(m).sum()) for n, m in zip(sizes, maps, strict=True)], np.int64)
    return SignatureTree(sizes, np.stack([np.tile(m, words // len(m)) for m in maps]), excess)


def possible(a: SignatureTree, la: int, ia: np.ndarray, b: SignatureTree, lb: int, ib: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the node pairs may hold linked members: at most common bits + shared-bit tokens overlap, and no more than the smaller size."""
    (x, lox, hix, ex), (y, loy, hiy, ey) = a.levels[la], b.levels[lb]
    most = np.bitwise_count(x[ia] & y[ib]).sum(axis=1, dtype=np.int64) + np.minimum(ex[ia], ey[ib])
    most = np.minimum(most, np.minimum(hix[ia], hiy[ib]))
    return (most * (num + den) >= num * (lox[ia] + loy[ib])) & (most * den >= num * np.maximum(lox[ia], loy[ib]))


def _children(tree: SignatureTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes, one level down, and the position of each one's parent in ``nodes``."""
    n = len(tree.levels[level - 1][0])
    kids = nodes[:, None] * tree.fan + np.arange(tree.fan)
    ok = kids < n
    return kids[ok], np.nonzero(ok)[0]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[i] = j
        return i != j


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both * den >= num * (len(a) + len(b) - both)


def dual_walk(a: SignatureTree, b: SignatureTree, num: int, den: int, leaf) -> None:
    """Calls ``leaf`` with arrays of member pairs that may link; each pair once where ``a`` is ``b``."""

    def walk(la: int, lb: int, ia: np.ndarray, ib: np.ndarray) -> None:
        while len(ia):
            ok = possible(a, la, ia, b, lb, ib, num, den)
            if a is b:
                ok &= ia < ib if la == 0 else ia <= ib
            ia, ib = ia[ok], ib[ok]
            if la == lb == 0:
                leaf(a.order[ia], b.order[ib])
                return
            if len(ia) > 1 << 12:  # piecewise, so that what is found early prunes what comes later
                for at in range(0, len(ia), 1 << 11):
                    walk(la, lb, ia[at : at + (1 << 11)], ib[at : at + (1 << 11)])
                return
            if la >= lb:
                ia, parent = _children(a, la, ia)
                ib, la = ib[parent], la - 1
                if a is b:
                    ib, parent = _children(b, lb, ib)
                    ia, lb = ia[parent], lb - 1
            else:
                ib, parent = _children(b, lb, ib)
                ia, lb = ia[parent], lb - 1

    walk(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, comps: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect members: of ``left`` among themselves, or of ``left`` with ``right`` (numbered behind).

    ``comps``: what is known to be connected. The result spans the same components as all links do.
    """
    sets = left + (right or [])
    union = _Union(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(comps):
        union.join(i, first.setdefault(c, i))
    links: list[tuple[int, int]] = []

    def verify(i: int, j: int) -> None:
        if union.find(i) != union.find(j) and _linked(sets[i], sets[j], num, den):
            union.join(i, j)
            links.append((i, j))

    if len(left) * len(right or left) <= 64:
        for i in range(len(left)):
            for j in range(len(left), len(sets)) if right else range(i + 1, len(left)):
                verify(i, j)
        return links
    tree = lambda part: _tree([len(s) for s in part], [signature(s, _width(len(s))) for s in part])
    a = tree(left)
    b, shift = (tree(right), len(left)) if right else (a, 0)
    if right and len(a.levels[0][0][0]) != len(b.levels[0][0][0]):  # both trees of the same width
        words = max(len(a.levels[0][0][0]), len(b.levels[0][0][0]))
        for t in (a, b):
            t.levels = [(np.tile(bits, (1, words // bits.shape[1])), *rest) for bits, *rest in t.levels]

    def leaf(ia: np.ndarray, ib: np.ndarray) -> None:
        roots = np.array([union.find(i) for i in range(len(sets))])
        other = roots[ia] != roots[ib + shift]
        for i, j in zip(ia[other].tolist(), (ib[other] + shift).tolist(), strict=True):
            verify(i, j)

    dual_walk(a, b, num, den, leaf)
    return links


def _grouped(batches: Pairs, *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:2] != current:
                if held:
                    yield current, held
                current, held = row[:2], []
            held.append(row[2:])
    if held:
        yield current, held


def _survivors(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(region, member) of rows (region, task, member, n, bits) without those whose bitmaps say that they link with no other there."""
    targets = 4 * max(partitions(rows.sparkSession), 16)

    def run(batches: Pairs) -> Pairs:
        out: list[tuple[int, int]] = []
        for (region, _), rows in _grouped(batches, "region", "task", "member", "n", "bits"):
            rows = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]  # a repeated row may come from several tasks
            keep = np.zeros(len(rows), bool)

            def leaf(ia: np.ndarray, ib: np.ndarray, keep: np.ndarray = keep) -> None:
                keep[ia] = keep[ib] = True

            if len(rows) > 1:
                tree = _tree([r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows])
                dual_walk(tree, tree, num, den, leaf)
            out += [(region, r[0]) for r, k in zip(rows, keep, strict=True) if k]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["region", "member"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["region", "member"])

    return rows.repartition(targets, "region").sortWithinPartitions("region", "member").mapInArrow(tidy(run), "region long, member long")


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links from rows (region, task, side, member, comp, tokens): side 0 alone is joined with itself, else 0 with 1."""
    targets = 4 * max(partitions(rows.sparkSession), 16)

    def run(batches: Pairs) -> Pairs:
        out: list[tuple[int, int]] = []
        for _, rows in _grouped(batches, "region", "task", "side", "member", "comp", "tokens"):
            rows = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]  # a repeated row may come from several tasks
            left = [r for r in rows if r[0] == 0]
            right = [r for r in rows if r[0] == 1]
            if not left or len(rows) < 2:
                continue
            every = left + right
            sets = [np.frombuffer(r[3], np.uint64) for r in every]
            found = tree_links(sets[: len(left)], sets[len(left) :] or None, [r[2] for r in every], num, den)
            out += [(every[i][1], every[j][1]) for i, j in found]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    dealt = rows.select("region", "task", "side", "member", "comp", "tokens").repartition(targets, "region", "task").sortWithinPartitions("region", "task", "side", "member")
    return materialize(dealt.mapInArrow(tidy(run), "a long, b long"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the smallest node of the component."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-graph")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "jaccard-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        up = labels.select(F.col("node").alias("up_node"), F.col("comp").alias("up"))
        jumped = step.join(up, F.col("next") == F.col("up_node"), "left").select("node", F.least("next", F.coalesce("up", "next")).alias("comp"), (F.least("next", F.coalesce("up", "next")) < F.col("comp")).alias("changed"))
        jumped = materialize(jumped, "jaccard-labels")
        labels = jumped.select("node", "comp")
        if jumped.filter("changed").isEmpty():
            return labels


def _fetch(source: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int, make, schema: str) -> DataFrame:
    """``wanted`` (member, ...) with the columns of ``schema``, which ``make`` makes of the member's set.

    The set is computed anew from one text of the class, where that text is read; nothing but the result is moved.
    """
    found = wanted.join(classes.select(F.col("k1").alias("member"), "row"), "member")
    spots = materialize(found.groupBy("row").agg(F.collect_set(F.struct(*wanted.columns)).alias("spots")), "jaccard-wanted")  # a member's own regions
    chosen = source.join(broadcast_if_small(spots, 32 + 64 * F.size("spots")), "row").select("text", "spots")
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    old, new = wanted.dtypes, [part.split() for part in schema.split(", ")]
    types = [kinds[kind] for _, kind in [*old, *new]]
    names = [name for name, _ in [*old, *new]]

    def run(batches: Pairs) -> Pairs:
        seen: set[int] = set()  # equal rows of this task say nothing new
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            rows = []
            for found, spots in zip(shingle_sets(data, offsets, shingle), batch.column("spots"), strict=True):
                if len(found) and (key := _class_key(found)[0]) not in seen:
                    seen.add(key)
                    made = make(found)
                    rows += [[*spot.values(), *made] for spot in spots.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=names)

    return chosen.mapInArrow(tidy(run), ", ".join(f"{name} {kind}" for name, kind in [*old, *new]))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 3, den: int = 4, bits: int | None = None, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of the component), n_copies (rows with an equal set)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))  # never null
    if bits is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(25, max(12, (size // 192).bit_length()))
    both = materialize(_sets(source, shingle, bits), "jaccard-sets")
    sets = both.filter("part is null").select("doc_id", "row", "n", "k1", "k2")
    counts = _sketch(both.filter("part is not null").select("part", "counts"), bits)
    classes = materialize(sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.max("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")
    total = classes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    regions = _regions(source, counts, total, shingle, num, den, hot)
    sizes = regions.groupBy("region").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = materialize(regions.join(sizes, "region").withColumn("mine", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")).cast("int")), "jaccard-placed")
    one = placed.filter("blocks = 1").select("region", F.lit("0").alias("task"), "member")
    bitmaps = _fetch(source, classes, one, shingle, lambda found: [len(found), signature(found, _width(len(found))).tobytes()], "n int, bits binary")
    kept = materialize(_survivors(bitmaps, num, den), "jaccard-survivors").withColumn("task", F.lit(0))
    wide = placed.filter("blocks > 1")
    spread = wide.select("region", "member", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))).alias("task"))
    wanted = kept.unionByName(spread).select("region", F.col("task").cast("string").alias("task"), F.lit(0).alias("side"), "member", F.col("member").alias("comp"))
    store = lambda wanted: _fetch(source, classes, wanted, shingle, lambda found: [found.tobytes()], "tokens binary")
    links = _search(store(wanted), num, den)
    if not wide.isEmpty():
        links = materialize(links.unionByName(_search(store(_across(wide, components(links), block)), num, den)), "jaccard-links")
    joined = components(links)
    named = joined.join(classes.groupBy("k1").agg(F.min("first").alias("first")), F.col("node") == F.col("k1"), "left")
    names = named.groupBy("comp").agg(F.min("first").alias("component"))
    of_class = materialize(joined.join(names, "comp").select(F.col("node").alias("k1"), "component"), "jaccard-names")
    full = materialize(classes.join(of_class, "k1", "left").select("k1", "k2", F.coalesce("component", "first").alias("component"), "copies"), "jaccard-named")
    s, f = sets.alias("s"), full.alias("f")
    out = s.join(f, (F.col("s.k1") == F.col("f.k1")) & (F.col("s.k2") == F.col("f.k2")) & (F.col("s.n") > 0), "left")
    return out.select("s.doc_id", F.col("s.n").cast("long").alias("n_shingles"), F.when(F.col("s.n") > 0, F.col("f.component")).otherwise(F.col("s.doc_id")).alias("component_id"), F.coalesce("f.copies", F.lit(1)).cast("long").alias("n_copies"))


def _across(placed: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(region, task, side, member, comp) for the links between the blocks of a region: members not connected with the leader, against all others."""
    named = placed.join(labels, F.col("member") == F.col("node"), "left").select("region", "member", "lead", F.coalesce("comp", "member").alias("comp"))
    named = materialize(named, "jaccard-across")
    main = named.filter("lead").select(F.col("region").alias("r"), F.col("comp").alias("main"))
    split = named.join(main, F.col("region") == F.col("r")).withColumn("loose", F.col("comp") != F.col("main")).drop("r", "main", "lead")
    split = materialize(split, "jaccard-split")
    counts = split.groupBy("region").agg(F.ceil(F.count_if("loose") / block).cast("int").alias("nl"), F.ceil(F.count_if(~F.col("loose")) / block).cast("int").alias("nc"))
    counts = materialize(counts.filter("nl > 0"), "jaccard-counts")
    dealt = split.join(counts, "region").withColumn("mine", F.pmod(F.xxhash64("member", F.lit(2)), F.when(F.col("loose"), F.col("nl")).otherwise(F.col("nc"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, x, y: F.concat_ws("-", F.lit(kind), x.cast("string"), y.cast("string"))
    me = F.col("mine")
    # a loose block against itself, against each later loose block, and against each connected block
    loose = F.concat(
        F.array(F.struct(task("l", me, me).alias("task"), F.lit(0).alias("side"))),
        F.transform(F.filter(every(F.col("nl")), lambda j: j > me), lambda j: F.struct(task("l", me, j).alias("task"), F.lit(0).alias("side"))),
        F.transform(F.filter(every(F.col("nl")), lambda j: j < me), lambda j: F.struct(task("l", j, me).alias("task"), F.lit(1).alias("side"))),
        F.transform(every(F.col("nc")), lambda j: F.struct(task("c", me, j).alias("task"), F.lit(0).alias("side"))),
    )
    firm = F.transform(every(F.col("nl")), lambda j: F.struct(task("c", j, me).alias("task"), F.lit(1).alias("side")))
    spread = dealt.select("region", "member", "comp", F.explode(F.when(F.col("loose"), loose).otherwise(firm)).alias("t"))
    return spread.select("region", "t.task", "t.side", "member", "comp")
