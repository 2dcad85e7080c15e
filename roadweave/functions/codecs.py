"""Text and binary codings of shapes, speeds, tags and times, as Spark expressions; gzip alone works on Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.shapes import let, total

BUCKETS, COEFFICIENTS = 2016, 200  # fixed values: five-minute buckets of a week, kept cosine coefficients
POINTS = "array<struct<x:double,y:double>>"


def deltas(pts: Column, precision: float) -> Column:
    """Zigzag numbers of the differences of neighbouring points, latitude first."""
    whole = lambda p: F.struct(F.floor(F.abs(p["y"]) * precision + 0.5).cast("long").alias("y"), F.floor(F.abs(p["x"]) * precision + 0.5).cast("long").alias("x"), (F.when(p["y"] < 0, -1).otherwise(1)).alias("sy"), (F.when(p["x"] < 0, -1).otherwise(1)).alias("sx"))
    signed = F.transform(F.transform(pts, whole), lambda p: F.struct((p["y"] * p["sy"]).alias("y"), (p["x"] * p["sx"]).alias("x")))
    zigzag = lambda v: F.when(v < 0, -2 * v - 1).otherwise(2 * v)

    def steps(q: Column) -> Column:
        return F.flatten(F.transform(q, lambda p, i: F.array(*(zigzag(p[c] - F.coalesce(F.get(q, i - 1)[c], F.lit(0))) for c in ("y", "x")))))

    return let(signed, steps)


def chunks(number: Column, bits: int) -> Column:
    """struct<part, more> of a number's groups of ``bits`` bits, lowest first."""
    one = lambda k: F.struct((F.floor(number / F.pow(F.lit(2.0), k * bits)).cast("long") % (1 << bits)).alias("part"), (number >= F.pow(F.lit(2.0), (k + 1) * bits)).alias("more"), k.alias("k"))
    every = F.transform(F.sequence(F.lit(0), F.lit(64 // bits - 2)), one)
    return F.filter(every, lambda c: (c["k"] == 0) | (number >= F.pow(F.lit(2.0), c["k"] * bits)))


def encode_polyline(pts: Column, digits: int = 6) -> Column:
    """Printable text of a shape: groups of five bits plus 63, all but a number's last plus 32 more."""
    text = lambda n: F.transform(chunks(n, 5), lambda c: F.char(c["part"] + 63 + F.when(c["more"], 32).otherwise(0)))
    return F.array_join(F.flatten(F.transform(deltas(pts, 10.0**digits), text)), "")


def encode7(pts: Column, digits: int = 6) -> Column:
    """Binary of a shape: groups of seven bits, all but a number's last with the high bit set."""
    byte = lambda n: F.transform(chunks(n, 7), lambda c: F.lpad(F.hex(c["part"] + F.when(c["more"], 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(F.flatten(F.transform(deltas(pts, 10.0**digits), byte)), ""))


def gathered(codes: Column, bits: int, digits: int) -> Column:
    """The points of a shape from its groups of bits; a group's bit above its value says that its number goes on."""
    size = F.lit(float(1 << bits))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("out"))

    def take(s: Column, c: Column) -> Column:
        value = s["held"] + ((c % (1 << bits)) * F.pow(size, s["k"])).cast("long")
        more = c >= (1 << bits)
        return F.struct(F.when(more, value).otherwise(F.lit(0).cast("long")).alias("held"), F.when(more, s["k"] + 1).otherwise(0).alias("k"), F.when(more, s["out"]).otherwise(F.concat(s["out"], F.array(F.when(value % 2 == 1, -F.floor((value + 1) / 2)).otherwise(F.floor(value / 2)).cast("long")))).alias("out"))

    def points(v: Column) -> Column:
        place = lambda i, odd: F.aggregate(F.filter(v, lambda _, j: (j % 2 == odd) & (j <= 2 * i + odd)), F.lit(0).cast("long"), lambda s, d: s + d) / 10.0**digits
        return F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda i: F.struct(place(i, 1).alias("x"), place(i, 0).alias("y")))

    numbers = F.aggregate(codes, start, take)["out"]
    return let(numbers, lambda v: F.when(F.size(v) >= 2, points(v)).otherwise(F.array().cast(POINTS)))


def decode_polyline(text: Column, digits: int = 6) -> Column:
    return gathered(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 63).cast("long")), 5, digits)


def decode7(data: Column, digits: int = 6) -> Column:
    text = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("long"))
    return gathered(codes, 7, digits)


def compress_speeds(speeds: Column) -> Column:
    """The first cosine coefficients (DCT-II) of a week of speeds, one a bucket, as whole numbers."""

    def one(c: Column) -> Column:
        terms = total(F.transform(speeds, lambda v, b: v * F.cos(math.pi / BUCKETS * (b + 0.5) * c)))
        return F.round(terms * math.sqrt(2 / BUCKETS) * F.when(c == 0, math.sqrt(0.5)).otherwise(1.0)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(COEFFICIENTS - 1)), one)


def speed_at(coefficients: Column, bucket: Column) -> Column:
    """The speed in one bucket (DCT-III)."""
    terms = F.transform(coefficients, lambda v, c: v * F.cos(math.pi / BUCKETS * (bucket + 0.5) * c) * F.when(c == 0, math.sqrt(0.5)).otherwise(1.0))
    return total(terms) * math.sqrt(2 / BUCKETS)


def encode_speeds(coefficients: Column) -> Column:
    """Base64 of the coefficients as big-endian 16-bit numbers."""
    return one_line(F.base64(F.unhex(F.array_join(F.transform(coefficients, lambda v: F.lpad(F.hex(F.pmod(v, F.lit(65536))), 4, "0")), ""))))


def one_line(text: Column) -> Column:
    """Base64 without the line ends that are put in after each 76 letters."""
    return F.translate(text, "\r\n", "")


def decode_speeds(text: Column) -> Column:
    """The coefficients, or null if the text isn't base64 of exactly as many; a bad row doesn't fail the job."""
    data = F.hex(F.try_to_binary(text, F.lit("base64")))
    number = lambda i: F.conv(F.substr(data, 4 * i + 1, F.lit(4)), 16, 10).cast("int")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(COEFFICIENTS - 1)), lambda i: let(number(i), lambda v: F.when(v >= 32768, v - 65536).otherwise(v)))
    return F.when(F.length(data) == 4 * COEFFICIENTS, numbers)


def kmh(text: Column) -> Column:
    """A tagged speed in km/h: ``50``, ``30 mph``, ``walk``, ``none``; null if it can't be read."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(text) == "none", 140).when(F.lower(text) == "walk", 10).when(F.lower(text).contains("mph"), F.floor(number * 1.609344 + 0.5)).when(F.lower(text).contains("knots"), F.floor(number * 1.852 + 0.5)).otherwise(F.floor(number + 0.5)).cast("int")


def tonnes(text: Column) -> Column:
    """A tagged weight in tonnes: ``3.5``, ``7000 kg``, ``5 st``, ``11000 lbs``."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"([a-zA-Z]+)\s*$", 1))
    return number * F.when(unit == "kg", 0.001).when(unit == "st", 0.90718474).when(unit.isin("lb", "lbs"), 0.00045359237).otherwise(1.0)


def tagged_metres(text: Column) -> Column:
    """A tagged length in metres: ``3.8``, ``12'6"``, ``380 cm``, ``13 ft``."""
    feet, inches = (F.regexp_extract(text, r"^\s*(\d+)'\s*(?:(\d+)\")?", k).try_cast("double") for k in (1, 2))
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    plain = number * F.when(F.lower(text).contains("cm"), 0.01).when(F.lower(text).contains("ft"), 0.3048).otherwise(1.0)
    return F.when(feet.isNotNull(), feet * 0.3048 + F.coalesce(inches, F.lit(0.0)) * 0.0254).otherwise(plain)


# fixed values: weekday names, and bits from Sunday on
DAYS = {"Su": 1, "Mo": 2, "Tu": 4, "We": 8, "Th": 16, "Fr": 32, "Sa": 64}
CARDINALS = ("North", "South", "East", "West", "N", "S", "E", "W", "NE", "NW", "SE", "SW", "Northeast", "Northwest", "Southeast", "Southwest")


def opening_hours(text: Column) -> Column:
    """struct<days, start, end> of each rule of ``Mo-Fr 07:00-09:00; Sa,Su 10:00-12:30``: a mask of days, Sunday lowest, and minutes.

    A rule without days means all of them, one without hours the whole day; a range of days may wrap around the week. Rules of
    holidays and rules that say ``off`` hold on no day.
    """
    order = F.array(*(F.lit(d) for d in DAYS))

    def mask(part: Column) -> Column:
        first, last = F.array_position(order, F.substr(part, F.lit(1), F.lit(2))), F.array_position(order, F.substr(part, F.lit(4), F.lit(2)))
        last = F.when(F.length(part) < 5, first).otherwise(last)
        span = F.pmod(last - first, F.lit(7))
        days = F.transform(F.sequence(F.lit(0).cast("long"), span), lambda k: F.pow(F.lit(2.0), F.pmod(first - 1 + k, F.lit(7))).cast("int"))
        return F.when(first > 0, F.aggregate(days, F.lit(0), lambda s, b: s.bitwiseOR(b))).otherwise(0)

    def minutes(rule: Column, k: int) -> Column:
        return F.regexp_extract(rule, r"(\d\d):(\d\d)-(\d\d):(\d\d)", 2 * k + 1).try_cast("int") * 60 + F.regexp_extract(rule, r"(\d\d):(\d\d)-(\d\d):(\d\d)", 2 * k + 2).try_cast("int")

    def one(rule: Column) -> Column:
        named = F.regexp_extract(rule, r"^([A-Z][a-z][A-Za-z,-]*)", 1)
        parts = F.filter(F.split(named, ","), lambda p: p != "")
        days = F.when(F.size(parts) > 0, F.aggregate(F.transform(parts, mask), F.lit(0), lambda s, b: s.bitwiseOR(b))).when(rule.rlike(r"^\d"), 127).otherwise(0)
        days = F.when(rule.rlike(r"\boff$"), 0).otherwise(days)
        return F.struct(days.alias("days"), F.coalesce(minutes(rule, 0), F.lit(0)).alias("start"), F.coalesce(minutes(rule, 1), F.lit(1440)).alias("end"))

    return F.transform(F.filter(F.transform(F.split(text, ";"), lambda r: F.trim(r)), lambda r: r != ""), one)


def open_at(rules: Column, day: Column, minute: Column) -> Column:
    """Whether any rule holds on a day (Sunday 0) at a minute; hours that end before they start run past midnight."""
    bit = lambda d: F.pow(F.lit(2.0), F.pmod(d, F.lit(7))).cast("int")
    on = lambda r, d: r["days"].bitwiseAND(bit(d)) != 0
    same = lambda r: on(r, day) & (minute >= r["start"]) & ((minute < r["end"]) | (r["end"] < r["start"]))
    over = lambda r: on(r, day - 1) & (r["end"] < r["start"]) & (minute < r["end"])
    return F.exists(rules, lambda r: same(r) | over(r))


def street_parts(name: Column) -> Column:
    """struct<prefix, base, suffix> of a name: a compass word at either end stands apart."""
    words = F.array(*(F.lit(c) for c in CARDINALS))

    def cut(w: Column) -> Column:
        n = F.size(w)
        first, last = F.array_contains(words, w[0]) & (n > 1), F.array_contains(words, F.element_at(w, -1)) & (n > 1)
        base = F.slice(w, F.when(first, 2).otherwise(1), n - F.when(first, 1).otherwise(0) - F.when(last & (n > 2), 1).otherwise(0))
        return F.struct(F.when(first, w[0]).otherwise("").alias("prefix"), F.array_join(base, " ").alias("base"), F.when(last & ((n > 2) | ~first), F.element_at(w, -1)).otherwise("").alias("suffix"))

    return let(F.split(name, " "), cut)


def joined_names(names: Column, delimiter: str = "/", most: int = 0) -> Column:
    """Names in order with a delimiter, at most ``most`` of them if that isn't 0."""
    return F.array_join(F.slice(names, 1, most) if most else names, delimiter)


def length_phrase(metres: Column) -> Column:
    """A length as it is said: tens of metres below 1 km, then kilometres to a half or a whole."""
    km = F.floor(metres / 500 + 0.5) / 2
    said = F.when(km == F.floor(km), km.cast("long").cast("string")).otherwise(F.format_number(km, 1))
    near = F.floor(metres / 10 + 0.5) * 10
    return F.when(metres < 10, "less than 10 meters").when(near < 1000, F.concat(near.cast("long").cast("string"), F.lit(" meters"))).when(km == 1, "1 kilometer").otherwise(F.concat(said, F.lit(" kilometers")))


def verbal_ref(ref: Column) -> Column:
    """A route number as it is said: ``I 405`` becomes ``Interstate 4 oh 5``, ``US 20`` ``U.S. 20``, ``CR 7`` ``County Route 7``."""
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(ref, r"^I[ -](?=\d)", "Interstate "), r"^US[ -](?=\d)", "U.S. "), r"^CR[ -](?=\d)", "County Route ")
    words = F.regexp_replace(words, r"(?<=\b\d)0(?=\d\b)", " oh ")
    return F.regexp_replace(words, r"(?<=\b\d)(?=[1-9]\d\b)", " ")


def levels(text: Column) -> Column:
    """Ranges of levels ``-1;0-2`` as struct<low, high>."""
    number = lambda r, k: F.regexp_extract(r, r"^(-?\d+(?:\.\d+)?)(?:-(-?\d+(?:\.\d+)?))?$", k).try_cast("double")
    found = F.transform(F.split(text, ";"), lambda r: F.struct(number(r, 1).alias("low"), F.coalesce(number(r, 2), number(r, 1)).alias("high")))
    return F.filter(found, lambda r: r["low"].isNotNull())
