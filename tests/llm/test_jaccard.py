"""The join against brute force."""

import random
import re

import numpy as np
import pytest

from privlytics.llm import jaccard_join as J
from privlytics.llm import queries


def sets_of(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(docs):
    sets = [(d, sets_of(t)) for d, t in docs]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, (_, s) in enumerate(sets):
        near = {}
        for x in s:
            for j in index.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            index[x].append(i)
        for j, n in near.items():
            if 100 * n >= 75 * len(s | sets[j][1]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for members in groups.values():
        ids = [sets[i][0] for i in members if sets[i][0] is not None]
        for i in members:
            least[i] = min(ids, default=None)
    return sorted(((d, len(s), least[i]) for i, (d, s) in enumerate(sets)), key=str)


def near_copies(rng, n, words=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "a b c d", "A b\tc  d", "a b c d e", "é a b c d", *near_copies(rng, 150), *near_copies(rng, 40, 25), *["same text for all of these copies here"] * 30]
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80))) + " " + passage for _ in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    rng.shuffle(texts)
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, "lonely null row of some words"), (5000, texts[0])]
    return docs


@pytest.mark.parametrize("kwargs", [{}, {"bits": 8, "hot": 3, "block": 16}])
def test_brute_force(spark, corpus, kwargs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus], "doc_id long, text string, comp string, part int").repartition(5)
    rows = J.jaccard_components(df, **kwargs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(corpus)
    times = {}
    for _, t in corpus:
        times[sets_of(t)] = times.get(sets_of(t), 0) + 1
    by_id = {d: times[sets_of(t)] if sets_of(t) else 1 for d, t in corpus if d is not None}
    assert {r.doc_id: r.n_copies for r in rows if r.doc_id is not None} == by_id


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).count() == 0
    one = spark.createDataFrame([(4, None)], "doc_id long, text string")
    assert [tuple(r) for r in J.jaccard_components(one).collect()] == [(4, 0, 4, 1)]


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op3_jaccard_join(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(docs)


def test_tree_links():
    rng = random.Random(5)
    left = [np.array(sorted(rng.sample(range(400), rng.randrange(1, 60))), np.uint64) for _ in range(120)]
    left += [np.unique(np.append(rng.choice(left), np.uint64(rng.randrange(10**6)))) for _ in range(120)]
    linked = lambda a, b: len(s := set(a.tolist()) & set(b.tolist())) * 4 >= 3 * (len(a) + len(b) - len(s))
    for right in (None, left[::3]):
        every = left + (right or [])
        want, got = J._Union(len(every)), J._Union(len(every))
        for i in range(len(left)):
            for j in range(len(left), len(every)) if right else range(i):
                if linked(every[i], every[j]):
                    want.join(i, j)
        for i, j in J.tree_links(left, right, list(range(len(every))), 3, 4):
            got.join(i, j)
        same = lambda u: [[u.find(i) == u.find(j) for j in range(len(every))] for i in range(len(every))]
        assert same(want) == same(got)


@pytest.mark.parametrize("kwargs", [{}, {"bits": 8, "hot": 3, "block": 16}])
def test_null_ids_link_and_bridge(spark, kwargs):
    words = [f"w{i}" for i in range(60)]
    changed = lambda a, b: " ".join([f"x{i}" for i in range(a)] + words[a : 60 - b] + [f"z{i}" for i in range(b)])
    docs = [(4, changed(0, 0)), (None, changed(4, 0)), (9, changed(4, 5)), (20, "other " + " ".join(f"y{i}" for i in range(30))), (None, " ".join(f"y{i}" for i in range(30)))]
    want = brute(docs)
    assert [x[2] for x in want if x[0] == 9] == [4] and brute([d for d in docs if d[0] is not None]) != [x for x in want if x[0] is not None]
    rows = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **kwargs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
