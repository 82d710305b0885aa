"""Mixing against numpy, and the pipeline stage by stage."""

import numpy as np
import pytest

import corpus_pipeline
from privlytics.llm import common, mixing, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed, goal, mean", [(1, [0.6, 0.3, 0.1], [0.3, 0.3, 0.3]), (2, [0.9, 0.1, 0.0], [2.0, 2.0, 2.0]), (3, [0.85, 0.15, 0.0], [5.0, 3.0, 0.4]), (4, [0.0, 0.0, 1.0], [4.0, 4.0, 1.0]), (5, [0.5, 0.5, 0.0], [1.0, 0.2, 6.0])])
def test_rates_fit(spark, seed, goal, mean):
    """Against a long run of plain projected gradient; some of the goals are out of reach, with many rates at 0."""
    rng = np.random.default_rng(seed)
    p = np.round(rng.dirichlet(mean, 400), 3)
    tokens, goal = rng.integers(0, 900, 400), np.array(goal)
    df = spark.createDataFrame([(i, 1, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, copies long, tokens long, p array<double>")
    rows = mixing.fit_rates(df, goal.tolist()).orderBy("doc_id").collect()
    rate = np.array([r.rate for r in rows])
    error = lambda rate: (rate * tokens) @ p / tokens.sum() - goal
    best = np.ones(400)
    length = np.linalg.eigvalsh((p * tokens[:, None]).T @ p / tokens.sum()).max()
    for _ in range(60_000):
        best = np.maximum(0, best - p @ error(best) / length)
    assert (rate >= 0).all()
    assert (error(rate) ** 2).sum() <= (error(best) ** 2).sum() * 1.02 + 3e-6


def test_rates_of_no_targets(spark):
    df = spark.createDataFrame([], "doc_id long, copies long, tokens long, p array<double>")
    assert mixing.fit_rates(df, [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError, match="targets"):
        mixing.fit_rates(df, [0.0, 0.0])


def test_mix_cases(spark):
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(["good fine words", "bad bad clown", None, "", "other text"] * 60)] + [(0, "good fine words", 9.0), (None, "clown", 9.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, "toxic" if i % 5 == 1 else "high") for i in range(300) if i % 5 < 2] + [(999, "high"), (None, "low"), (4, None)], "doc_id long, domain string")
    out = mixing.join_rates(docs, mixing.mix_sources(docs, labels, {"high": 1.0, "toxic": 0.0})).collect()
    assert len(out) == 302 and all(r.rate is not None and r.rate >= 0 for r in out)
    high = {r.text: r.p[0] for r in out}
    assert high["good fine words"] > 0.9 > 0.5 > high["bad bad clown"]
    assert len({r.rate for r in out if r.doc_id == 0}) == 1
    unlabelled = mixing.join_rates(docs, mixing.mix_sources(docs, labels.limit(0), {"high": 1.0, "toxic": 0.0})).collect()
    assert len(unlabelled) == 302 and len({tuple(r.p) for r in unlabelled}) == 1
    empty = mixing.join_rates(docs.limit(0), mixing.mix_sources(docs.limit(0), labels, {"high": 1.0, "toxic": 0.0}))
    assert empty.count() == 0


def test_mixing_table(spark):
    rows = queries.op7_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    domains = sorted(queries.TARGETS)
    p = np.array([[r[f"p_{d}"] for d in domains] for r in rows])
    tokens, goal = np.array([r.n_tokens for r in rows]), np.array([queries.TARGETS[d] for d in domains])
    error = lambda rate: (rate * tokens) @ p / tokens.sum() - goal
    best = np.ones(len(rows))  # plain projected gradient, as far as soft membership lets the targets be met
    for _ in range(5000):
        best = np.maximum(0, best - 0.5 * p @ error(best))
    assert np.abs(error(np.array([r.rate for r in rows]))).sum() < np.abs(error(best)).sum() + 0.02
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(r.p_toxic > 0.5) == bool(toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    assert sum(right) / len(right) > 0.93


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or len(out.columns) == len(docs.columns))
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{name}"
        out.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(kept["language_id"]) >= 0.98 * len(every)
    comps = {r.doc_id: r.component_id for r in queries.op3_jaccard_join(spark, SF).collect()}
    assert set(kept["near_duplicates"]) <= set(kept["language_id"])
    assert len({comps[d] for d in kept["near_duplicates"]}) == len({comps[d] for d in kept["language_id"]}) == len(kept["near_duplicates"])
    dirty = {r.doc_id for r in queries.op5_decontaminate(spark, SF).filter("contaminated").collect()}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - dirty
    assert set(kept["secrets"]) == set(kept["decontamination"])
    secret = {r.doc_id for r in queries.op6_secret_scan(spark, SF).filter("n_access + n_hex + n_assign > 0").collect()}
    assert all((kept["secrets"][d] != kept["decontamination"][d]) == (d in secret) for d in kept["secrets"])
    assert not any("AKIA" in (t or "") and "AKIA" in t and "[SECRET]" not in t for t in kept["secrets"].values())
    assert len(kept["mixing"]) >= 0.85 * len(kept["secrets"])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(toxic & set(kept["mixing"])) <= 0.6 * len(toxic & set(kept["secrets"]))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "the words of a text", "en", "s", 19)]])
def test_pipeline_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.select("doc_id", "text").collect()
        assert len(got) <= len(rows)
        docs = spark.createDataFrame([tuple(r) for r in out.select(*docs.columns).collect()], docs.schema)


def test_duplicates_keep_rows_without_an_id_and_other_texts(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcde"]
    near = lambda t: t + " more"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, near(texts[3])), (None, near(texts[4])), (9, texts[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.duplicates_stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_workers_keep_no_free_memory():
    """Blocks that were freed below one that is in use: without ``tidy`` they stay with the process."""
    pins = []
    mine = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20  # noqa: E731, SIM115

    def work(batches):
        held = [b"x" * 50_000 for _ in range(4000)]
        pins.append(b"y" * 50_000)
        del held
        yield from batches

    start = mine()
    assert list(work(iter([1, 2]))) == [1, 2] and mine() - start > 120
    assert list(common.tidy(work)(iter([1, 2]))) == [1, 2] and mine() - start < 60
