"""Quasi-identifiers: bands of birth years, regions, tuples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: County code -> NUTS-2 region.
COUNTY_NUTS2 = {
    "01": "RO12", "02": "RO42", "03": "RO31", "04": "RO21", "05": "RO11", "06": "RO11", "07": "RO21", "08": "RO12", "09": "RO22", "10": "RO22",
    "11": "RO42", "12": "RO11", "13": "RO22", "14": "RO12", "15": "RO31", "16": "RO41", "17": "RO22", "18": "RO41", "19": "RO12", "20": "RO42",
    "21": "RO31", "22": "RO21", "23": "RO32", "24": "RO11", "25": "RO41", "26": "RO12", "27": "RO21", "28": "RO41", "29": "RO31", "30": "RO11",
    "31": "RO11", "32": "RO12", "33": "RO21", "34": "RO31", "35": "RO42", "36": "RO22", "37": "RO21", "38": "RO41", "39": "RO22", "40": "RO32",
    "41": "RO32", "42": "RO32", "43": "RO32", "44": "RO32", "45": "RO32", "46": "RO32", "51": "RO31", "52": "RO31",
}
FIELDS = ("dob_band", "sex", "nuts2", "nationality", "isco_major", "rare_condition")


def dob_band(date: Column) -> Column:
    """The five years from a multiple of five as yyyy-yyyy; null without a year."""
    year = F.substring(date, 1, 4)
    low = F.floor(F.when(year.rlike("^[0-9]{4}$"), year.try_cast("int")) / 5).cast("int") * 5
    return F.when(low.isNotNull(), F.format_string("%04d-%04d", low, low + 4))


def county_nuts2(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in COUNTY_NUTS2.items() for x in pair)), code)


def qi_tuple(**fields: Column) -> Column:
    """struct of all fields, missing ones null; rare_condition only if true; null where every field is."""
    values = {f: fields.get(f, F.lit(None).cast("boolean" if f == "rare_condition" else "string")) for f in FIELDS}
    values["rare_condition"] = F.when(values["rare_condition"], True)
    return F.when(F.coalesce(*(v.cast("string") for v in values.values())).isNotNull(), F.struct(*(v.alias(f) for f, v in values.items())))
