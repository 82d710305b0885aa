"""Whitespace tokens with code-point offsets, as expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once

#: Fixed value: what splits tokens, spelled out as regex dialects differ.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same as signs.
SIGNS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def blanks(text: Column) -> Column:
    """With a blank for each sign of white space: a pattern of all of these takes forty times as long as one of the blank."""
    return F.translate(text, SIGNS, " " * len(SIGNS))


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(blanks(text), F.lit("[^ ]+"), F.lit(0)))


def _token(at: Column, run: Column) -> Column:
    tok = F.ltrim(run)
    end = at + F.char_length(run)
    return F.named_struct(F.lit("tok"), tok, F.lit("s"), end - F.char_length(tok), F.lit("e"), end)


def whitespace_tokens(text: Column) -> Column:
    """array<struct<tok,s,e>>: maximal runs of other than white space; end exclusive."""
    runs = F.regexp_extract_all(blanks(text), F.lit(" *[^ ]+"), F.lit(0))
    return F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tok:string,s:int,e:int>>").alias("out")),
        lambda acc, r: F.named_struct(F.lit("at"), acc["at"] + F.char_length(r), F.lit("out"), F.concat(acc["out"], F.array(_token(acc["at"], r)))),
        lambda acc: acc["out"],
    )


def bioes(owners: Column, labels: Column) -> Column:
    """Tags of tokens from the entity that owns each (-1: none) and the token's label; neighbours of one owner are one entity."""

    def tags(x: Column) -> Column:
        owners, labels = x["owners"], x["labels"]

        def tag(owner: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(owners, i - 1)).otherwise(F.lit(-1))
            after = F.coalesce(F.get(owners, i + 1), F.lit(-1))
            first, last = before != owner, after != owner
            mark = F.when(first & last, "S").when(first, "B").when(last, "E").otherwise("I")
            return F.when(owner < 0, "O").otherwise(F.concat(mark, F.lit("-"), F.get(labels, i)))

        return F.transform(owners, tag)

    # bound, as each token looks at its neighbours: else all owners would be worked out again for each
    return once(F.struct(owners.alias("owners"), labels.alias("labels")), tags)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SIGNS))
