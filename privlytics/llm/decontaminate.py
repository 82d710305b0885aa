"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (an item with fewer is one window), a window into shingles of up
to three words. Containment of a whole window needs every one of its shingles, so its necessary prefix is one shingle;
shingles are ordered by rarity, as counted over all documents, and the rarest is the one that is joined. A candidate must
lie within its document (length bound) where the prefix shingle's place puts it (positional bound), and counts only if all
shingles of the window stand there word by word, which is exact containment.

All documents are exploded once into their shingles; only those that some item has are kept, and these few rows serve for
counts, candidates and verification; the words are counted in the same pass. So what the rare prefix saves is the work on
candidates; the explosion comes before, as the counts that tell what is rare need it. The table of the items' shingles is
broadcast if its measured size is small and shuffled otherwise. Counts are by shingle, summed in each task first; matches
are grouped by document.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Documents are told apart by (id, text), so equal
rows have equal results. Cases: null or empty text has no words; items with null id or without words are left out; equal
item ids count once; an empty benchmark hits nothing. Columns of the input with clashing names do not matter: only id and
text are read. Very long texts are read whole, in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize

#: As the words' pattern, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item_id, words): every window of every item."""
    w = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(ascii_lower(F.col(text))).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    return w.withColumn("at", at).select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("w")).distinct()


def _shingles(w: Column, k: Column) -> Column:
    """array<struct<off,shingle>> of an array of words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("off"), F.array_join(F.slice(w, i + 1, k), " ").alias("shingle")))


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, row_hash, spans array<struct<start,len>> in words, n_hit, item_ids sorted as strings): documents that are hit."""
    return _search(docs, items, window, doc_id, text, item_id, item_text, count=False)[0]


def _search(docs: DataFrame, items: DataFrame, window: int, doc_id: str, text: str, item_id: str, item_text: str, count: bool) -> tuple[DataFrame, DataFrame | None]:
    """Hits as of ``find_hits``; with ``count`` (doc_id, row_hash, n_words) of all documents as well, unless no item has words."""
    item_windows = materialize(_windows(items, window, item_id, item_text).withColumn("window", F.array_join("w", " ")), "bench-windows")
    k = F.least(F.lit(3), F.size("w"))
    wins = item_windows.select("window", F.size("w").alias("len"), k.alias("k"), _shingles(F.col("w"), k).alias("sh")).dropDuplicates(["window"])
    parts = materialize(wins.select("window", "len", "k", F.size("sh").alias("n"), F.explode("sh").alias("s")).select("window", "len", "k", "n", "s.off", "s.shingle"), "bench-shingles")
    known = parts.select("k", "shingle").distinct().withColumn("key", F.lower("shingle"))
    lengths = [r[0] for r in parts.select("k").distinct().collect()]  # 3 values at most
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_hash"), words(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    known = broadcast_if_small(known, F.length("shingle") * 2 + 64)

    def matches(n: int, told: bool) -> DataFrame:
        """Shingles that items have; with ``told`` also each document's first row, so that its words are counted in the same pass."""
        cols = [F.col("w"), *(F.slice("w", F.lit(i + 1), F.greatest(F.col("n_words") - i, F.lit(0))) for i in range(1, n))]
        zipped = F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(cols))) if n > 1 else F.transform("w", lambda x: F.struct(x.alias("c0")))
        named = source.select("doc_id", "row_hash", "n_words", F.posexplode_outer(zipped.cast("array<struct<" + ",".join(f"c{i}:string" for i in range(n)) + ">>")).alias("pos", "c"))
        # outer: for the inner one Spark infers a filter that repeats the regular expression; nulls are filtered next
        text_of = F.concat_ws(" ", *(F.col(f"c.c{i}") for i in range(n)))
        first = F.coalesce("pos", F.lit(0)) == 0
        full = F.col(f"c.c{n - 1}").isNotNull()
        rows = named.filter(full | first if told else full).select("doc_id", "row_hash", "n_words", "pos", text_of.alias("found")).withColumn("key", F.lower("found"))
        joined = rows.join(known.filter(F.col("k") == n), "key", "left" if told else "inner").withColumn("shingle", F.when(ascii_lower(F.col("found")) == F.col("shingle"), F.col("shingle")))
        return joined.filter(F.col("shingle").isNotNull() | first if told else F.col("shingle").isNotNull()).select("doc_id", "row_hash", "n_words", "pos", "shingle")

    schema = source.select("doc_id", "row_hash", "n_words", F.lit(0).alias("pos"), F.lit("").alias("shingle"))
    found = materialize(reduce(DataFrame.unionByName, [matches(n, count and i == 0) for i, n in enumerate(lengths)], schema.limit(0)), "bench-matches")
    sizes = found.select("doc_id", "row_hash", "n_words").distinct() if count and lengths else None
    found = found.filter(F.col("shingle").isNotNull())
    counts = found.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = parts.join(counts, "shingle").groupBy("window", "len", "n").agg(F.count("*").alias("present"), F.min_by(F.struct("shingle", "off"), F.struct("df", "shingle", "off")).alias("prefix"))
    prefix = ranked.filter("present = n").select("window", "len", "n", "prefix.shingle", "prefix.off")
    start = F.col("pos") - F.col("off")
    candidates = found.join(broadcast_if_small(materialize(prefix, "bench-prefix"), F.length("window") + 64), "shingle").withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    candidates = candidates.select("doc_id", "row_hash", "start", "window", "len", "n").distinct()
    steps = broadcast_if_small(parts.select(F.col("window").alias("in_window"), "off", F.col("shingle").alias("needed")), F.length("needed") + F.length("in_window") + 64)
    c = candidates.join(steps, F.col("window") == F.col("in_window")).withColumn("pos", F.col("start") + F.col("off")).alias("c")
    f = found.select("doc_id", "row_hash", "pos", "shingle").distinct().alias("f")
    on = F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.row_hash") == F.col("f.row_hash")) & (F.col("c.pos") == F.col("f.pos")) & (F.col("c.needed") == F.col("f.shingle"))
    occurs = c.join(f, on).groupBy("c.doc_id", "c.row_hash", "c.start", "c.window", "c.len", "c.n").agg(F.count("*").alias("seen")).filter("seen = n")
    owners = item_windows.select(F.col("window").alias("of_window"), "item_id").distinct()
    both = occurs.join(broadcast_if_small(owners, F.length("of_window") + 64), F.col("window") == F.col("of_window"))
    hits = both.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["len"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    return materialize(hits.withColumn("n_hit", covered), "bench-hits"), sizes


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids, spans."""
    hits, sizes = _search(docs, items, window, "doc_id", "text", "item_id", "text", count=True)
    hits = hits.withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
    row_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash")
    if sizes is None:
        all_docs = docs.select("doc_id", row_hash, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    else:
        rows = docs.select("doc_id", row_hash)
        sizes = sizes.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), F.col("n_words").cast("long").alias("n_words"))
        all_docs = rows.join(sizes, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["row_hash"] == F.col("_row"))).select("doc_id", "row_hash", "n_words")
    joined = all_docs.join(hits, all_docs["doc_id"].eqNullSafe(F.col("_id")) & (all_docs["row_hash"] == F.col("_hash")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without those that any window of an item occurs in."""
    hits = find_hits(docs, items, window).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    hits = broadcast_if_small(hits, F.lit(32))
    return docs.join(hits, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_hash")), "left_anti")
