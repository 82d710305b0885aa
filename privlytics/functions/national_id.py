"""Validators of national ids as expressions: struct<valid, sex, birth_date, place_code>. ASCII digits only."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once
from .tokens import strip

RESULT = "struct<valid:boolean,sex:string,birth_date:string,place_code:string>"
# Weights and tables of the public check-digit rules.
CNP_WEIGHTS = (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
BALTIC_FIRST, BALTIC_SECOND = (1, 2, 3, 4, 5, 6, 7, 8, 9, 1), (3, 4, 5, 6, 7, 8, 9, 1, 2, 3)
EMSO_WEIGHTS = (7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)
# by letter A to Z, or digit
CF_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
CF_MONTHS, CF_OMOCODIA = "ABCDEHLMPRST", "LMNPQRSTUV"
HETU_CONTROLS = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def digit(v: Column, i: int) -> Column:
    return (F.ascii(F.substring(v, i, 1)) - 48).cast("long")


def number(v: Column, start: int, n: int) -> Column:
    """Null where it is no number; shapes are checked apart."""
    return F.substring(v, start, n).try_cast("long")


def weighted(v: Column, weights: Sequence[int]) -> Column:
    return sum((digit(v, i + 1) * w for i, w in enumerate(weights) if i), digit(v, 1) * weights[0])


def plausible_date(y: Column, m: Column, d: Column) -> Column:
    def there(t: Column) -> Column:
        y, m, d = t["y"], t["m"], t["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return m.between(1, 12) & (d >= 1) & (d <= last)

    return once(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), there)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))


def _result(valid: Column, sex: Column | None = None, date: Column | None = None, place: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    row = lambda ok, *c: F.named_struct(F.lit("valid"), F.lit(ok), F.lit("sex"), text(c[0]), F.lit("birth_date"), text(c[1]), F.lit("place_code"), text(c[2])).cast(RESULT)
    return F.when(valid, row(True, sex, date, place)).otherwise(row(False, None, None, None))


def _digits(v: Column, n: int) -> Column:
    return v.rlike(f"^[0-9]{{{n}}}$")


def _of(clean: Callable[[Column], Column]) -> Callable:
    """A parser of a cleaned value, which is worked out once."""

    def made(parser: Callable[[Column], Column]) -> Callable[[Column], Column]:
        @functools.wraps(parser)
        def parse_one(value: Column) -> Column:
            return once(clean(value), parser)

        return parse_one

    return made


@_of(lambda value: strip(value))
def parse_ro(v: Column) -> Column:
    check = once(weighted(v, CNP_WEIGHTS) % 11, lambda rem: F.when(rem == 10, 1).otherwise(rem))
    s, m, d = digit(v, 1), number(v, 4, 2), number(v, 6, 2)
    century = F.when(s.isin(1, 2), 1900).when(s.isin(3, 4), 1800).when(s.isin(5, 6), 2000)
    year = century + number(v, 2, 2)
    dated = F.when(century.isNotNull(), plausible_date(year, m, d)).otherwise(m.between(1, 12) & d.between(1, 31))
    valid = _digits(v, 13) & (check == digit(v, 13)) & (s != 0) & dated
    return _result(valid, F.when(s % 2 == 1, "M").otherwise("F"), F.when(century.isNotNull(), _date(year, m, d)), F.substring(v, 8, 2))


@_of(lambda value: strip(value))
def parse_pl(v: Column) -> Column:
    raw, d = number(v, 3, 2), number(v, 5, 2)
    band = raw - raw % 20
    year = F.when(band == 0, 1900).when(band == 20, 2000).when(band == 40, 2100).when(band == 60, 2200).when(band == 80, 1800) + number(v, 1, 2)
    valid = _digits(v, 11) & ((10 - weighted(v, PESEL_WEIGHTS) % 10) % 10 == digit(v, 11)) & plausible_date(year, raw % 20, d)
    return _result(valid, F.when(digit(v, 10) % 2 == 1, "M").otherwise("F"), _date(year, raw % 20, d))


@_of(lambda value: F.replace(F.upper(strip(value)), F.lit("-"), F.lit("")))
def parse_es(v: Column) -> Column:
    v = F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.expr("''"), F.substr(v, F.lit(2), F.length(v)))
    letter = F.substr(F.lit(DNI_LETTERS), (number(v, 1, 8) % 23 + 1).cast("int"), F.lit(1))
    return _result(v.rlike("^[0-9]{8}[A-Z]$") & (letter == F.substring(v, 9, 1)))


@_of(lambda value: strip(value))
def parse_de(v: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.ascii(F.substr(v, i, F.lit(1))) - 48)
    step = lambda product, d: F.when((d + product) % 10 == 0, 10).otherwise((d + product) % 10) * 2 % 11
    check = 11 - F.aggregate(digits, F.lit(10), step)
    return _result(_digits(v, 11) & (digit(v, 1) != 0) & (F.when(check == 10, 0).otherwise(check) == digit(v, 11)))


@_of(lambda value: F.when(F.length(strip(value)) == 8, F.concat(F.lit("0"), strip(value))).otherwise(strip(value)))
def parse_nl(v: Column) -> Column:
    return _result(_digits(v, 9) & once(weighted(v, BSN_WEIGHTS), lambda total: (total % 11 == 0) & (total != 0)))


@_of(lambda value: strip(value))
def parse_baltic(v: Column) -> Column:
    second = once(weighted(v, BALTIC_SECOND) % 11, lambda two: F.when(two < 10, two).otherwise(0))
    check = once(weighted(v, BALTIC_FIRST) % 11, lambda one: F.when(one < 10, one).otherwise(second))
    g, m, d = digit(v, 1), number(v, 4, 2), number(v, 6, 2)
    year = 1800 + F.floor((g - 1) / 2) * 100 + number(v, 2, 2)
    valid = _digits(v, 11) & g.between(1, 8) & (check == digit(v, 11)) & plausible_date(year, m, d)
    return _result(valid, F.when(g % 2 == 1, "M").otherwise("F"), _date(year, m, d))


@_of(lambda value: F.replace(strip(value), F.lit(" "), F.lit("")))
def parse_si(v: Column) -> Column:
    check = once(11 - weighted(v, EMSO_WEIGHTS) % 11, lambda rem: F.when(rem >= 10, 0).otherwise(rem))
    y, m, d = number(v, 5, 3), number(v, 3, 2), number(v, 1, 2)
    year = F.when(y > 800, 1000 + y).otherwise(2000 + y)
    valid = _digits(v, 13) & (check == digit(v, 13)) & plausible_date(year, m, d)
    return _result(valid, F.when(number(v, 10, 3) < 500, "M").otherwise("F"), _date(year, m, d), F.substring(v, 8, 2))

def _letter_index(c: Column) -> Column:
    """0 to 9 for digits, 0 to 25 for letters."""
    code = F.ascii(c)
    return F.when(code < 58, code - 48).otherwise(code - 65).cast("int")


@_of(lambda value: F.upper(strip(value)))
def parse_it(v: Column) -> Column:
    """Two-digit years: dates are yy-mm-dd; February has 29 days. Letters that stand for digits are read as these."""
    part = lambda i: _letter_index(F.substr(v, i, F.lit(1)))
    table = F.array(*map(F.lit, CF_ODD))
    terms = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.when(i % 2 == 1, F.get(table, part(i))).otherwise(part(i)))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 26
    back = lambda start, n: F.translate(F.substring(v, start, n), CF_OMOCODIA, "0123456789")
    yy, dd, place = back(7, 2), back(10, 2), F.concat(F.substring(v, 12, 1), back(13, 3))
    month = F.instr(F.lit(CF_MONTHS), F.substring(v, 9, 1))
    day = number(dd, 1, 2)
    real = F.when(day > 40, day - 40).otherwise(day)
    shape = v.rlike("^[A-Z]{6}[A-Z0-9]{10}$") & yy.rlike("^[0-9]{2}$") & dd.rlike("^[0-9]{2}$")
    valid = shape & (F.char(total + 65) == F.substring(v, 16, 1)) & (month > 0) & plausible_date(F.lit(2000), month, real)
    return _result(valid, F.when(day > 40, "F").otherwise("M"), F.concat_ws("-", yy, F.format_string("%02d-%02d", month, real.cast("int"))), place)


@_of(lambda value: F.replace(F.upper(strip(value)), F.lit(" "), F.lit("")))
def parse_fr(v: Column) -> Column:
    """Two-digit years and no day: dates are yy-mm, null where the month is not known."""
    dept = F.substring(v, 6, 2)
    body = F.concat(F.substring(v, 1, 5), F.when(dept == "2A", "19").when(dept == "2B", "18").otherwise(dept), F.substring(v, 8, 6))
    month = number(v, 4, 2)
    valid = v.rlike("^[0-9]{5}([0-9]{2}|2A|2B)[0-9]{8}$") & (97 - number(body, 1, 13) % 97 == number(v, 14, 2))
    sex = F.when(digit(v, 1) == 1, "M").when(digit(v, 1) == 2, "F")
    return _result(valid, sex, F.when(month.between(1, 12), F.concat_ws("-", F.substring(v, 2, 2), F.substring(v, 4, 2))), dept)


@_of(lambda value: F.translate(strip(value), "-+ ", ""))
def parse_se(full: Column) -> Column:
    """Dates are yyyy-mm-dd for twelve digits, else yy-mm-dd; a day over 60 is that day less 60."""
    return once(F.when(_digits(full, 12), F.substring(full, 3, 10)).otherwise(full), lambda v: _parse_se(full, v))


def _parse_se(full: Column, v: Column) -> Column:
    long = _digits(full, 12)
    doubled = lambda i: digit(v, i) * 2 - F.when(digit(v, i) > 4, 9).otherwise(0)
    total = sum((digit(v, i) for i in (2, 4, 6, 8)), sum((doubled(i) for i in (3, 5, 7, 9)), doubled(1)))
    y, m, d = number(v, 1, 2), number(v, 3, 2), number(v, 5, 2)
    day = F.when(d > 60, d - 60).otherwise(d)
    year = number(full, 1, 4)
    dated = F.when(long, plausible_date(year, m, day)).otherwise(m.between(1, 12) & day.between(1, 31))
    valid = _digits(v, 10) & ((10 - total % 10) % 10 == digit(v, 10)) & dated
    short = F.format_string("%02d-%02d-%02d", y.cast("int"), m.cast("int"), day.cast("int"))
    return _result(valid, F.when(digit(v, 9) % 2 == 1, "M").otherwise("F"), F.when(long, _date(year, m, day)).otherwise(short))


@_of(lambda value: F.translate(strip(value), "/ ", ""))
def parse_cz(v: Column) -> Column:
    raw = number(v, 3, 2)
    woman = raw.between(51, 62) | raw.between(71, 82)
    base = F.when(woman, raw - 50).otherwise(raw)
    month = F.when(base.between(21, 32), base - 20).otherwise(base)
    ten, yy = _digits(v, 10), number(v, 1, 2)
    check = (number(v, 1, 10) % 11 == 0) | ((number(v, 1, 9) % 11 == 10) & (digit(v, 10) == 0))
    year = F.when(ten & (yy < 54), 2000 + yy).otherwise(1900 + yy)
    valid = (_digits(v, 9) | (ten & check)) & plausible_date(year, month, number(v, 5, 2))
    return _result(valid, F.when(woman, "F").otherwise("M"), _date(year, month, number(v, 5, 2)))


@_of(lambda value: F.translate(strip(value), "- ", ""))
def parse_dk(v: Column) -> Column:
    mark, yy = digit(v, 7), number(v, 5, 2)
    century = F.when(mark <= 3, 1900).when(mark.isin(4, 9), F.when(yy < 37, 2000).otherwise(1900)).otherwise(F.when(yy < 58, 2000).otherwise(1800))
    m, d = number(v, 3, 2), number(v, 1, 2)
    return _result(_digits(v, 10) & plausible_date(century + yy, m, d), F.when(digit(v, 10) % 2 == 1, "M").otherwise("F"), _date(century + yy, m, d))


@_of(lambda value: F.upper(strip(value)))
def parse_fi(v: Column) -> Column:
    mark = F.substring(v, 7, 1)
    century = F.when(mark == "+", 1800).when(mark.isin(*"-YXWVU"), 1900).otherwise(2000)
    whole = number(v, 1, 6) * 1000 + number(v, 8, 3)
    control = F.substr(F.lit(HETU_CONTROLS), (F.pmod(whole, F.lit(31)) + 1).cast("int"), F.lit(1))
    year, m, d = century + number(v, 5, 2), number(v, 3, 2), number(v, 1, 2)
    valid = v.rlike("^[0-9]{6}[-+YXWVUABCDEF][0-9]{3}[0-9A-Z]$") & (control == F.substring(v, 11, 1)) & plausible_date(year, m, d)
    return _result(valid, F.when(digit(v, 10) % 2 == 1, "M").otherwise("F"), _date(year, m, d))


PARSERS: dict[str, Callable[[Column], Column]] = {"RO": parse_ro, "PL": parse_pl, "ES": parse_es, "DE": parse_de, "NL": parse_nl, "EE": parse_baltic, "LT": parse_baltic, "SI": parse_si, "IT": parse_it, "FR": parse_fr, "SE": parse_se, "CZ": parse_cz, "SK": parse_cz, "DK": parse_dk, "FI": parse_fi}
DECODE_BEARING = ("RO", "PL", "EE", "LT", "SI", "IT", "FR", "SE", "CZ", "SK", "DK", "FI")


def parse(country: Column, value: Column) -> Column:
    """Dispatch by explicit country; unknown ones are not valid."""
    invalid = _result(F.lit(False))
    out = F.when(country.isNull(), invalid)
    for cc, parser in PARSERS.items():
        out = out.when(country == cc, parser(value))
    return out.otherwise(invalid)


def supported_countries() -> list[str]:
    return sorted(PARSERS)


def disclosed(parsed: Column, country: Column) -> Column:
    """How many quasi-identifiers (sex, birth date, place) a valid id gives away; 0 for countries whose ids hold none."""
    told = sum((parsed[f].isNotNull().cast("int") for f in ("birth_date", "place_code")), parsed["sex"].isNotNull().cast("int"))
    return F.when(parsed["valid"] & country.isin(*DECODE_BEARING), told).otherwise(0).cast("long")


#: Places of birth by their code in Italian ids, as of 2024-01-01: towns, and countries (codes with Z).
TOWNS = {"H501": "Roma", "F205": "Milano", "F839": "Napoli", "L219": "Torino", "G273": "Palermo", "D969": "Genova", "A944": "Bologna", "D612": "Firenze", "L736": "Venezia", "C351": "Catania", "A662": "Bari", "L424": "Trieste"}
COUNTRIES = {"Z100": "Albania", "Z112": "Germania", "Z114": "Regno Unito", "Z133": "Romania", "Z200": "Egitto", "Z210": "Marocco", "Z301": "Stati Uniti d'America", "Z330": "Brasile", "Z404": "Cina", "Z222": "India"}


def birth_place(code: Column) -> Column:
    """struct<code,kind,name> of a place code whose digits are restored: a foreign country, a town, or unknown; the name is null where it is not listed."""
    c = F.upper(strip(code))
    named = lambda places: F.try_element_at(F.create_map(*(F.lit(x) for place in places.items() for x in place)), c)
    abroad, town = c.startswith("Z"), named(TOWNS)
    kind = F.when(abroad, "foreign_country").when(town.isNotNull(), "comune").otherwise("unknown")
    return F.when(c.isNotNull(), F.struct(c.alias("code"), kind.alias("kind"), F.when(abroad, named(COUNTRIES)).otherwise(town).alias("name")))
