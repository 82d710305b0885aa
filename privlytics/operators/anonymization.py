"""Masked and pseudonymised texts: leaks, consistency, retention, disruption. Counts first, one division last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlytics.functions.redaction import is_mask, mask_spans, value_survives, words
from privlytics.functions.stats import wilson
from privlytics.functions.tokens import SPACE, token_count, whitespace_tokens


def anonymize(rows: DataFrame) -> DataFrame:
    """(detector, doc_id, redacted) of (detector, doc_id, text, pred)."""
    return rows.select("detector", "doc_id", mask_spans(F.col("text"), F.col("pred")).alias("redacted"))


def survivors(subjects: DataFrame, redacted: DataFrame) -> DataFrame:
    """Subjects by detector, detected unless a part of the value survives in the redacted text."""
    both = redacted.join(subjects.hint("merge"), "doc_id")  # merged as in information_retention
    return both.select("detector", "doc_id", "country", "value", (~value_survives(F.col("redacted"), F.col("value"))).alias("detected"))


def redaction_report(subjects: DataFrame, redacted: DataFrame) -> DataFrame:
    """Per detector: subjects (doc_id, value, qi), those of whom a part survives masking, their share with its interval, and what they give away."""
    both = redacted.join(subjects.hint("merge"), "doc_id").select("detector", "qi", value_survives(F.col("redacted"), F.col("value")).alias("left"))
    n = both.groupBy("detector").agg(F.count("*").alias("subjects_total"), F.count_if(F.col("left")).alias("subjects_leaked"), F.coalesce(F.sum(F.when(F.col("left"), F.col("qi"))), F.lit(0)).cast("long").alias("leaked_quasi_identifiers"))
    low, high = wilson(F.col("subjects_leaked"), F.col("subjects_total"))
    return n.select("detector", "subjects_total", "subjects_leaked", (F.col("subjects_leaked") / F.col("subjects_total").cast("double")).alias("leak_rate"), F.round(low, 12).alias("leak_rate_ci_low"), F.round(high, 12).alias("leak_rate_ci_high"), "leaked_quasi_identifiers")


def pseudonyms(mentions: DataFrame, buckets: int = 1024) -> DataFrame:
    """(label, entity, surrogate) of mentions (doc_id, pos, label, value): LABEL_n, numbered in order of first sight.

    Numbers are counted within ranges of doc_id and lifted by the counts of the ranges before, so that no label, however
    common, is numbered in one task.
    """
    entity = F.regexp_replace("value", f"[{SPACE}]+", "")
    first = mentions.groupBy("label", entity.alias("entity")).agg(F.min(F.struct("doc_id", "pos")).alias("seen"))
    low, high = mentions.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    placed = first.withColumn("bucket", F.floor((F.col("seen.doc_id") - (low or 0)) / width))
    counts = placed.groupBy("label", "bucket").count()  # at most labels x buckets rows
    before = F.coalesce(F.sum("count").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = placed.join(counts.select("label", "bucket", before.alias("before")), ["label", "bucket"])
    n = F.col("before") + F.row_number().over(Window.partitionBy("label", "bucket").orderBy("seen", "entity"))
    return lifted.select("label", "entity", F.concat_ws("_", "label", n.cast("string")).alias("surrogate"))


def surrogate_maps(mentions: DataFrame, buckets: int = 1024) -> DataFrame:
    """(doc_id, surrogates map<value,surrogate>) of documents with mentions, by values as they are written; of a value's mentions the last counts."""
    entity = F.regexp_replace("value", f"[{SPACE}]+", "")
    named = mentions.withColumn("entity", entity).join(pseudonyms(mentions, buckets), ["label", "entity"])
    last = named.groupBy("doc_id", "value").agg(F.max_by("surrogate", F.struct("pos", "label")).alias("surrogate"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("surrogates"))


def bijection_rate(pairs: DataFrame, *scope: str) -> DataFrame:
    """Share of entities (within ``scope``) with one surrogate that no other entity has; 1 where there are none."""
    one = pairs.select(*scope, "entity", "surrogate").distinct()
    shared = one.groupBy(*scope, "surrogate").agg(F.count("*").alias("sharers"))
    good = one.join(shared, [*scope, "surrogate"]).groupBy(*scope, "entity").agg((F.count("*") == 1).alias("single"), (F.max("sharers") == 1).alias("own"))
    return good.agg(F.coalesce(F.count_if(F.col("single") & F.col("own")) / F.nullif(F.count("*"), F.lit(0)).cast("double"), F.lit(1.0)).alias("rate"))


def information_retention(docs: DataFrame, redacted: DataFrame) -> DataFrame:
    """Share of the tokens outside gold spans that the redacted text still has, counted as multisets for each document."""
    outside = F.filter(whitespace_tokens(F.col("text")), lambda t: ~F.exists("gold", lambda g: (t["s"] < g["end"]) & (t["e"] > g["start"])))
    gold = docs.select("doc_id", F.transform(outside, lambda t: t["tok"]).alias("toks"))
    # documents meet by their id alone, so that words stay in the task that has the document; merged, as for a small input file
    # Spark takes all words of all documents for small and sends them to every executor
    listed = lambda rows, name, *by: rows.groupBy(*by).agg(F.flatten(F.collect_list("toks")).alias(name))
    both = listed(redacted.select("detector", "doc_id", words(F.col("redacted")).alias("toks")), "out", "detector", "doc_id").join(listed(gold, "gold", "doc_id").hint("merge"), "doc_id")
    marked = lambda name: F.transform(name, lambda t: F.struct(t.alias("tok"), F.lit(name).alias("side")))
    each = both.select("detector", "doc_id", F.explode(F.concat(marked("gold"), marked("out"))).alias("t")).groupBy("detector", "doc_id", "t.tok")
    n = each.agg(F.count_if(F.col("t.side") == "gold").alias("n_gold"), F.count_if(F.col("t.side") == "out").alias("n_out"))
    kept = n.groupBy("detector").agg(F.sum(F.least("n_gold", "n_out")).alias("kept"))
    total = gold.agg(F.sum(F.size("toks")).alias("total"))
    every = redacted.select("detector").distinct().join(kept, "detector", "left").join(F.broadcast(total))  # one row
    return every.select("detector", F.coalesce(F.coalesce("kept", F.lit(0)) / F.nullif(F.col("total"), F.lit(0)).cast("double"), F.lit(1.0)).alias("retention"))


def structural_disruption(docs: DataFrame, redacted: DataFrame) -> DataFrame:
    """Share of mask tokens, and the mean change of a document's number of tokens in relation to it."""
    base = docs.select("doc_id", token_count(F.col("text")).alias("n_in"))
    out = redacted.select("detector", "doc_id", words(F.col("redacted")).alias("w")).select("detector", "doc_id", F.size("w").alias("n_out"), F.size(F.filter("w", is_mask)).alias("masks"))
    change = F.abs(F.col("n_out") - F.col("n_in")) / F.greatest(F.col("n_in"), F.lit(1)).cast("double")
    g = out.join(base, "doc_id").groupBy("detector")
    return g.agg((F.sum("masks") / F.greatest(F.sum("n_out"), F.lit(1)).cast("double")).alias("mask_ratio"), F.round(F.avg(change), 9).alias("length_delta"))
