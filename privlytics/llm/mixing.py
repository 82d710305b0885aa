"""Mixing sources to target weights with soft membership.

A naive Bayes classifier over the tokens that documents contain, each domain against the others with a calibrated logistic
curve, is learned from a labelled table (on a bounded sample of
about ``sample`` labelled documents) and gives each document posteriors over the domains.
A document's rate is how often it should be used. Nonnegative rates are fitted so that the expected tokens of each domain,
sum of rate x tokens x posterior, are in the target proportions while the total stays as it is: least squares by projected
gradient, with a small weight (``evenness``) on the rates' squared distance from 1, so that of all rates that do as well
the evenest are found. The rates are at any time the projection of 1 - p x force onto rates of 0 and more, with one force
for each domain; a step moves the forces along the gradient, scaled by the inverse Gram matrix of the documents with
rates over 0, or plainly by 1 / L, whichever of a few tried lengths does best. Each step is one distributed aggregation over
the table of (tokens, posteriors); the driver sees a few numbers for each pair of domains, and the rate stays one short
expression, whatever the number of steps. The weight is lowered tenfold each time the steps have arrived, down to
``evenness`` or until the targets are met. Where they are out of reach, a small ``evenness`` means that few documents are
used often.

Tokens are runs of letters and digits or of other signs, and a mark for how the number of distinct tokens grows with that of all (the ratio of their logarithms). Documents
are told apart by (id, text). Each text's scores are summed before the shuffle, so no domain, source or text can be hot.

Cases: null or empty text: no tokens, prior posteriors, a rate like any other. Repeated rows count each and get one rate
each. Very long texts count by all their tokens. Empty labels: all posteriors are alike. Only zero targets: ValueError. Labels of unknown documents or with null domains are not used; a domain without labels is only as likely as
smoothing makes it. Labels of a document that disagree count each. Columns with clashing names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Rows that a token's rates are drawn to the mean by; standard deviations that a token must stand out by.
SHRINK, SURPRISE = 5.0, 4.0
#: Sums of log weights are bent towards this.
BEND = 8.0
#: Tried lengths of the steps that are scaled by the inverse Gram matrix; a plain step of length 1 / L comes with them.
SCALED = (1.0, 0.4, 0.1)
TOKEN = r"[\p{L}\p{N}]++|[^\p{L}\p{N}\s]++"


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n, tokens): n tokens, and the distinct ones with marks.

    To be exploded with ``explode_outer``: for ``explode`` Spark infers a filter that repeats the regular expressions.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("all"))
    base = base.select("doc_id", "row_hash", F.size("all").alias("n"), F.array_distinct("all").alias("d"))
    growth = F.floor(40 * F.log(F.size("d") + 1.0) / F.log(F.col("n") + 1.0))
    marks = F.array(F.lit("\n"), F.concat(F.lit("\nd"), F.when(F.col("n") > 0, growth).otherwise(-1).cast("string")))
    return base.select("doc_id", "row_hash", "n", F.concat("d", marks).alias("tokens"))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = 6000) -> tuple[DataFrame, list[tuple[float, float]]]:
    """((token, w array<double>): log weights of a token for each domain against the others, calibration curves).

    The token of a line break is in every document and weighs nothing.
    """
    known = labels.filter(F.col("domain").isin(domains)).select("doc_id", "domain")
    rate = min(1.0, sample / max(1, known.count()))
    drawn = materialize(known.filter(F.crc32(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / 2.0**32 < rate), "mix-labels")
    # about ``sample`` rows of two short columns
    rows = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "domain", "text")
    seen = _features(rows.withColumn("doc_id", F.struct("doc_id", "domain"))).select(F.col("doc_id.domain").alias("domain"), F.explode_outer("tokens").alias("token"))
    df = seen.groupBy("token").agg(*(F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)))
    df = materialize(df, "mix-counts")
    totals = df.filter(F.col("token") == "\n").first()
    sizes = [float(totals[f"d{i}"]) if totals else 0.0 for i in range(len(domains))]
    total = sum((F.col(f"d{i}") for i in range(1, len(domains))), F.col("d0"))
    rows_n = max(1.0, sum(sizes))
    # each domain against the others: log of the rates' ratio, drawn to 0 by ``SHRINK`` rows; 0 where it does not stand out
    weights = []
    for i, n in enumerate(sizes):
        here, rest = F.col(f"d{i}"), total - F.col(f"d{i}")
        expected = total * n / rows_n
        ratio = F.log((here + SHRINK * total / rows_n) / (n + SHRINK) * (rows_n - n + SHRINK) / (rest + SHRINK * total / rows_n))
        z = F.abs(here - expected) / F.sqrt(expected + 1)
        weights.append(F.when(z >= SURPRISE, F.struct(z.alias("z"), ratio.alias("w"))).otherwise(F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("w"))))
    both = df.filter(F.col("token") != "\n").withColumn("zw", F.array(*weights)).withColumn("z", F.array_max(F.transform("zw", lambda x: x["z"])))
    best = both.filter("z > 0").select("token", F.transform("zw", lambda x: x["w"]).alias("w"))
    zeros = F.array(*(F.lit(0.0) for _ in domains))
    one = docs.sparkSession.range(1).select(F.lit("\n").alias("token"), zeros.alias("w"))
    table = materialize(best.unionByName(one), "mix-weights")
    told = rows.withColumn("doc_id", F.struct("doc_id", "domain"))
    scored = _sums(told, table, len(domains)).select(F.col("doc_id.domain").alias("domain"), "doc_id", "s").orderBy("doc_id").collect()  # about ``sample`` rows
    x = np.array([r.s for r in scored], float).reshape(len(scored), len(domains))
    y = np.array([domains.index(r.domain) for r in scored], int)
    return table, [_platt(x[:, i], y == i) for i in range(len(domains))]


def _platt(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(a, b) of the logistic curve a * x + b, by Newton's method with a little ridge."""
    f = np.stack([x, np.ones(len(x))], axis=1)
    prior = np.array([1.0, 0.0])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = f.T @ (f * (p * (1 - p))[:, None]) + 0.5 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, f.T @ (p - y) + 0.5 * (w - prior)), -2, 2)
    return float(w[0]), float(w[1])


def _sums(docs: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(doc_id, row_hash, n, copies, s array<double>): sums of the weights of each (id, text), bent by a tanh: long texts are not surer without end."""
    each = _features(docs).select("doc_id", "row_hash", "n", F.explode_outer("tokens").alias("token"))
    hit = each.join(broadcast_if_small(weights, F.octet_length("token") + 64), "token")  # tokens of the bounded sample that stand out
    # the token of every document counts the rows, so that repeated rows do not add up
    summed = hit.groupBy("doc_id", "row_hash", "n").agg(F.count_if(F.col("token") == "\n").alias("copies"), *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)))
    return summed.select("doc_id", "row_hash", "n", "copies", F.array(*(BEND * F.tanh(F.col(f"s{i}") / F.col("copies") / BEND) for i in range(k))).alias("s"))


def posteriors(docs: DataFrame, weights: DataFrame, curves: list[tuple[float, float]]) -> DataFrame:
    """(doc_id, row_hash, copies, tokens, p array<double>): one row for each different (id, text)."""
    summed = _sums(docs, weights, len(curves))
    parts = [1 / (1 + F.exp(-(F.col("s")[i] * a + b))) for i, (a, b) in enumerate(curves)]
    return summed.select("doc_id", "row_hash", "copies", F.col("n").cast("long").alias("tokens"), F.transform(F.array(*parts), lambda x: x / sum(parts[1:], parts[0])).alias("p"))


def fit_rates(table: DataFrame, targets: list[float], evenness: float = 1e-6, tolerance: float = 1e-3) -> DataFrame:
    """``table`` (copies, tokens, p) with ``rate``: nonnegative least squares of the domains' shares.

    Ends where every share is within ``tolerance`` of its target, or where the gradient at a weight of ``evenness`` is below
    a tenth of ``tolerance`` of the error. The number of steps has no limit: each makes the convex objective smaller.
    """
    if sum(targets) <= 0 or min(targets) < 0:
        raise ValueError("targets: nonnegative weights that are not all 0")
    n = len(targets)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    goal = np.array(targets, float) / sum(targets)
    total = float(table.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0)
    if not total:
        return table.withColumn("rate", F.lit(1.0))

    def rate_of(force: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("p")[i] * float(force[i]) for i in range(1, n)), F.col("p")[0] * float(force[0])))

    def look(forces: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each of some forces: the squared rates, the error, and the Gram matrix of the documents with rates over 0."""
        rows = table.select((F.col("copies") * F.col("tokens") / total).alias("w"), *(F.col("p")[i].alias(f"p{i}") for i in range(n)), *(rate_of(f).alias(f"r{c}") for c, f in enumerate(forces)))
        sums = []
        for c in range(len(forces)):
            r = F.col(f"r{c}")
            sums += [F.sum(F.col("w") * r * r), *(F.sum(F.col("w") * r * F.col(f"p{i}")) for i in range(n))]
            sums += [F.sum(F.when(r > 0, F.col("w") * F.col(f"p{i}") * F.col(f"p{j}"))) for i, j in pairs]
        got = np.array([float(x or 0) for x in rows.agg(*sums).first()]).reshape(len(forces), -1)
        out = []
        for line in got:
            gram = np.zeros((n, n))
            for (i, j), x in zip(pairs, line[1 + n :], strict=True):
                gram[i, j] = gram[j, i] = x
            out.append((line[0], line[1 : 1 + n] - goal, gram))
        return out

    force, weight = np.zeros(n), 1.0
    squares, error, gram = look([force])[0]
    length = float(np.linalg.eigvalsh(gram).max())
    while np.abs(error).max() > tolerance:
        slope = weight * force - error
        if np.abs(slope).max() > 0.1 * tolerance * np.abs(error).max():
            step = np.linalg.solve(gram + weight * np.eye(n), slope)
            tried = [force - x * step for x in SCALED] + [force - slope / (length + weight)]
            found = look(tried)
            objective = lambda f, sq: 0.5 * weight * f @ f + 0.5 * sq + goal @ f
            best = min(range(len(tried)), key=lambda c: objective(tried[c], found[c][0]))
            if objective(tried[best], found[best][0]) < objective(force, squares):
                force, (squares, error, gram) = tried[best], found[best]
                continue
        if weight <= evenness * 1.0001:
            break
        weight = max(weight / 10, evenness)
    return table.withColumn("rate", rate_of(force))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float], evenness: float = 1e-4) -> DataFrame:
    """(doc_id, row_hash, tokens, p, rate) for each different (id, text); ``labels``: (doc_id, domain), ``targets``: domain -> weight."""
    domains = sorted(targets)
    table = materialize(posteriors(docs, *fit_classifier(docs, labels, domains)), "mix-posteriors")
    return materialize(fit_rates(table, [targets[d] for d in domains], evenness), "mix-rates")


def join_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with ``rate``, ``p`` and ``tokens`` of their (id, text)."""
    new = ("rate", "p", "tokens")
    # the hash is a column before the join, so that texts are only moved where they are asked for
    base = docs.drop(*new).withColumn("_mine", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = rates.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), *new)
    return base.join(found, base["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_hash")), "left").drop("_id", "_hash", "_mine")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic): toxic, else high or low by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))
