"""BIOES tags over the whitespace tokens of one row, as expressions.

Spans are array<struct<start,end,label,..>> with code-point offsets, end exclusive; tags are aligned to the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once
from .tokens import bioes

SPAN = "struct<start:int,end:int,label:string>"


def _touch(t: Column, s: Column) -> Column:
    return (t["s"] < s["end"]) & (t["e"] > s["start"])


def owners(tokens: Column, spans: Column) -> Column:
    """For each token the position of the first span in list order that overlaps it, or -1."""
    return F.transform(tokens, lambda t: F.coalesce(F.array_position(F.transform(spans, lambda s: _touch(t, s)), True), F.lit(0)).cast("int") - 1)


def gold_violation(tokens: Column, spans: Column) -> Column:
    """Why spans can't be gold (overlap, no token, shared token), or null."""
    order = F.array_sort(spans)
    before = F.transform(order, lambda s, i: F.when(i > 0, F.get(order, i - 1)["end"] > s["start"]).otherwise(False))
    return (
        F.when(F.exists(before, lambda x: x), "overlapping spans")
        .when(F.exists(spans, lambda s: ~F.exists(tokens, lambda t: _touch(t, s))), "span without token")
        .when(F.exists(tokens, lambda t: F.size(F.filter(spans, lambda s: _touch(t, s))) > 1), "token of two spans")
    )


def gold_tags(tokens: Column, spans: Column) -> Column:
    """Tags of spans without a violation; each span is one entity."""
    return once(spans, lambda ss: once(owners(tokens, ss), lambda own: bioes(own, F.transform(own, lambda o: F.get(ss, o)["label"]))))


def label_tags(labels: Column) -> Column:
    """Tags of predicted labels (null: none); neighbours of one label are one entity."""
    place = lambda kinds: lambda x: F.when(x.isNull(), -1).otherwise(F.array_position(kinds, x).cast("int"))
    return once(labels, lambda ls: once(F.array_distinct(ls), lambda kinds: bioes(F.transform(ls, place(kinds)), ls)))


def entity_tags(tokens: Column, entities: Column) -> Column:
    """Tags of predicted entities: for each token the first in list order wins."""
    return once(entities, lambda es: label_tags(F.transform(owners(tokens, es), lambda o: F.get(es, o)["label"])))


def tags_violation(tags: Column) -> Column:
    """Position of the first tag that is malformed, continues nothing, or leaves its entity open; or null."""
    kind = lambda t: F.substring(t, 1, 1)
    name = lambda t: F.substr(t, F.lit(3), F.length(t))

    def bad(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tags, i - 1)).otherwise("O")
        after = F.coalesce(F.get(tags, i + 1), F.lit("O"))
        malformed = ~t.rlike("^(O|[BIES]-.+)$")
        stray = kind(t).isin("I", "E") & ~(kind(before).isin("B", "I") & (name(before) == name(t)))
        opened = kind(t).isin("B", "I") & ~(kind(after).isin("I", "E") & (name(after) == name(t)))
        return malformed | stray | opened

    found = F.array_position(F.transform(tags, bad), True)
    return F.when(found > 0, found - 1)


def tag_spans(tokens: Column, tags: Column) -> Column:
    """Spans of tags: an entity starts at B, S, a stray I or E, and where the type changes; a missing E ends it as well."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kind, name = F.substring(x["tag"], 1, 1), F.substr(x["tag"], F.lit(3), F.length(x["tag"]))
        last = F.try_element_at(acc["out"], F.lit(-1))
        goes_on = acc["open"] & kind.isin("I", "E") & (last["label"] == name)
        new = F.named_struct(F.lit("start"), F.when(goes_on, last["start"]).otherwise(x["t"]["s"]), F.lit("end"), x["t"]["e"], F.lit("label"), name).cast(SPAN)
        kept = F.when(goes_on, F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"])
        out = F.when(kind == "O", acc["out"]).otherwise(F.concat(kept, F.array(new)))
        return F.struct((kind.isin("B", "I") & F.lit(True)).alias("open"), out.alias("out"))

    pairs = F.zip_with(tokens, tags, lambda t, g: F.struct(t.alias("t"), g.alias("tag")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def fair_tags(tags: Column, allowed: Column) -> Column:
    """Tags whose type is in ``allowed``, else O."""
    return F.transform(tags, lambda t: F.when(F.array_contains(allowed, F.substr(t, F.lit(3), F.length(t))), t).otherwise("O"))
