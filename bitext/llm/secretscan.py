"""Secret scans: fixed patterns, and a battery of randomness tests for keys that no pattern names.

A key is a run of 20 characters or more that some encoding could have made. The battery asks whether its symbols look
drawn evenly and independently (chi-squared against the encoding's alphabet, runs above and below its middle, serial
correlation), and whether ordinary text could look so even by chance: the same chi-squared under the letter frequencies
of all documents gives a p-value that falls with the key's length. Of each encoding and length class, as many keys are
taken as Benjamini and Hochberg's rule allows.

Everything is DataFrame expressions; positions are running sums of the lengths of what lies between matches and of the
matches. Only counts of characters (one row) and of p-values (some thousand rows at most) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Fixed patterns: kind, pattern, the group whose length counts, and its least length. A run of 24 is the same as a run
#: of any length of which the shorter ones are dropped.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What the method adds.
ADDED = "random"
#: Keys: least and most characters (a longer run is tested in parts).
LEAST, MOST = 20, 512
KEY = rf"[A-Za-z0-9+/_-]{{{LEAST},{MOST}}}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet: name, pattern, whether case is folded, alphabet. A key has the first that fits.
ENCODINGS = [
    ("base16", r"^([0-9a-f]+|[0-9A-F]+)$", True, DIGITS + LOWER[:6]),
    ("base32", r"^[A-Z2-7]+$", True, LOWER + DIGITS[2:8]),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", True, DIGITS + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", False, DIGITS + UPPER + LOWER),
    ("base64", r"^([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)$", False, DIGITS + UPPER + LOWER + "+/"),
]
#: Beyond this many standard deviations a test of evenness rejects (two-sided 0.001).
REJECT = 3.2905
#: Share of false ones among the keys that are taken, and steps of p-values to a halving.
LEVEL, STEPS, WORST = 0.01, 8, 1023
#: Running sums are made in blocks of so many, so that arrays are not copied as a whole for each entry.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """Running sums of an array of longs."""

    def add(values: Column, start: Column) -> Column:
        sums = F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return sums

    def of(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / BLOCK).cast("int") - 1, F.lit(0)))
        part = lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
        zero = F.lit(0).cast("long")
        return let(add(totals, zero), lambda before: F.flatten(F.transform(numbers, lambda b: F.slice(add(part(b), F.get(before, b)), F.lit(2), F.lit(BLOCK)))))

    return let(steps, of)


def _length(c: Column) -> Column:
    return F.char_length(c).cast("long")


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """``start, end, value, between`` of the pattern's leftmost matches that do not overlap, whose ``group`` has at
    least ``least`` characters, in code points; null without any match. ``between`` is all text before the match and
    after the match before it, dropped ones included; the last entry has no value and the rest of the text."""
    p = F.lit(pattern)

    def build(parts: Column, found: Column, groups: Column) -> Column:
        before = lambda i: F.coalesce(_length(F.get(found, i - 1)), F.lit(0))
        steps = F.transform(parts, lambda x, i: _length(x) + before(i))

        def entries(starts: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                value = F.get(found, i)
                kept = F.coalesce(F.char_length(F.get(groups, i)) >= least, F.lit(False))
                start = F.get(starts, i)
                return F.struct(start.alias("start"), (start + F.coalesce(_length(value), F.lit(0))).alias("end"), value.alias("value"), x.alias("between"), kept.alias("kept"))

            return F.transform(parts, one)

        return let(running(steps), entries)

    found = lambda g: F.regexp_extract_all(text, p, F.lit(g))
    whole = let(F.split(text, pattern, -1), lambda parts: let(found(0), lambda all0: build(parts, all0, all0) if not group else let(found(group), lambda g: build(parts, all0, g))))
    return F.when(F.rlike(text, p), whole)


def _spans(found: Column, kind: int) -> Column:
    """The kept matches as ``start, kind, end``."""
    spans = F.transform(F.filter(found, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def _hidden(text: Column, found: Column) -> Column:
    """The text with blanks in place of the kept matches."""
    pieces = F.transform(found, lambda x: F.concat(x["between"], F.when(x["kept"], F.repeat(F.lit(" "), F.char_length(x["value"]))).otherwise(F.coalesce(x["value"], F.lit("")))))
    return F.coalesce(F.array_join(pieces, ""), text)


def tests(value: Column) -> Column:
    """What the battery finds of a key: its encoding's number and length, chi-squared, and how many standard deviations
    its runs and serial correlation are from even draws; null if no encoding with letters and digits fits."""

    def of(number: int, fold: bool, alphabet: str) -> Column:
        size, half = len(alphabet), len(alphabet) // 2
        plain = F.lower(value) if fold else F.translate(value, "-_", "+/")

        def battery(key: Column) -> Column:
            n = F.char_length(key).cast("double")
            count = lambda c: n - F.char_length(F.replace(key, c, F.lit("")))
            squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda a, c: a + let(count(c), lambda o: o * o))
            numbers = F.transform(F.sequence(F.lit(1), F.char_length(key)), lambda i: F.instr(F.lit(alphabet), F.substr(key, i, F.lit(1))).cast("double"))
            return let(
                F.struct(
                    n.alias("n"),
                    (size / n * squares - n).alias("chi"),
                    let(F.translate(key, alphabet, "0" * half + "1" * (size - half)), _runs).alias("runs"),
                    let(numbers, _serial).alias("serial"),
                ),
                lambda t: F.struct(F.lit(number).alias("encoding"), t["n"].cast("int").alias("n"), t["chi"].alias("chi"), t["runs"].alias("runs"), t["serial"].alias("serial")),
            )

        return let(plain, battery)

    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    out = None
    for number, (_, pattern, fold, alphabet) in enumerate(ENCODINGS):
        fits = mixed & F.rlike(value, F.lit(pattern))
        out = F.when(fits, of(number, fold, alphabet)) if out is None else out.when(fits, of(number, fold, alphabet))
    return out


def _runs(bits: Column) -> Column:
    """Standard deviations of the number of runs (Wald and Wolfowitz); far out if all symbols are in one half."""
    n = F.char_length(bits).cast("double")
    cuts = (2 * n - F.char_length(F.replace(bits, F.lit("01"), F.lit(""))) - F.char_length(F.replace(bits, F.lit("10"), F.lit("")))) / 2
    ones = n - F.char_length(F.replace(bits, F.lit("1"), F.lit("")))
    both = 2 * ones * (n - ones)
    variance = both * (both - n) / (n * n * (n - 1))
    return F.when((both > 0) & (variance > 0), (cuts - both / n) / F.sqrt(variance)).otherwise(F.lit(99.0))


def _serial(v: Column) -> Column:
    """Standard deviations of the correlation of neighbours (lag 1); far out if all symbols are equal."""
    n = F.size(v).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    mean = total(v) / n
    spread = total(F.transform(v, lambda a: a * a)) - n * mean * mean
    products = total(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b))
    shared = products - mean * (2 * total(v) - F.get(v, F.lit(0)) - F.element_at(v, -1)) + (n - 1) * mean * mean
    return F.when(spread > 1e-9, (shared / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))


def unevenness(docs: DataFrame) -> list[float]:
    """For each encoding, by how much a character of ordinary text raises chi-squared: the letters' frequencies in all
    of ``docs(text)`` against even ones."""
    symbols = DIGITS + UPPER + LOWER + "+/_-"
    counted = docs.agg(*[F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(symbols)]).first()
    n = {c: counted[f"c{i}"] or 0 for i, c in enumerate(symbols)}
    n["+"], n["/"] = n["+"] + n["-"], n["/"] + n["_"]
    out = []
    for _, _, fold, alphabet in ENCODINGS:
        own = [n[c] + (n[c.upper()] if fold and c.isalpha() else 0) for c in alphabet]
        whole = sum(own)
        out.append(len(own) * sum(x * x for x in own) / whole**2 - 1 if whole else 0.0)
    return out


def lower_tail(z: Column) -> Column:
    """The normal distribution's lower tail (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)


def rarity(test: Column, uneven: list[float]) -> Column:
    """How many steps the p-value of a key has been halved by: the chance that ordinary text of its length looks so
    even. 0 if the battery rejects even and independent draws."""
    per_encoding = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), test["encoding"])
    free = per_encoding(len(a) - 1 for *_, a in ENCODINGS)
    excess = per_encoding(uneven) * test["n"]
    p = lower_tail((test["chi"] - free - excess) / F.sqrt(2 * free + 4 * excess))
    even = ((test["chi"] - free) / F.sqrt(2 * free) <= REJECT) & (F.abs(test["runs"]) <= REJECT) & (F.abs(test["serial"]) <= REJECT)
    return F.when(even, F.least(F.floor(-STEPS * F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(WORST)).cast("int")).otherwise(F.lit(0))


def length_class(test: Column) -> Column:
    return (test["encoding"] * 100 + F.floor(2 * F.log2(test["n"].cast("double"))).cast("int")).alias("class")


def thresholds(keys: DataFrame) -> dict[int, int]:
    """By class, from which rarity on keys are taken: the lowest r for which the keys of ordinary text expected among
    all (their number times the p-value of r) are at most ``LEVEL`` of those found. ``keys(class, rarity)``."""
    counts: dict[int, dict[int, int]] = {}
    for r in keys.groupBy("class", "rarity").count().collect():  # at most 1,024 for each of some 20 classes
        counts.setdefault(r["class"], {})[r["rarity"]] = r["count"]
    out = {}
    for name, own in counts.items():
        whole, found = sum(own.values()), 0
        for r in sorted(own, reverse=True):
            found += own[r]
            if r > 0 and whole * 2.0 ** (-r / STEPS) <= LEVEL * found:
                out[name] = r
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs(doc_id, text)``: the secrets as an array of ``start, kind, end`` in code
    points (end exclusive; ``kind`` is a place in :data:`KINDS`, or after its end for a key that the battery found), by
    start, then kind.

    Null texts are empty; repeated rows and rows with a null doc_id are scanned each; an empty table gives no rows;
    other columns are ignored. Keys are looked for in what the patterns leave; runs beyond ``MOST`` characters are
    tested in parts of that many, of which a last one under ``LEAST`` is left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = rows.select("doc_id", "text", *[matches(F.col("text"), pattern, group, least).alias(name) for name, pattern, group, least in KINDS])
    left = F.col("text")
    spans = F.concat(*[_spans(F.col(name), k) for k, (name, *_) in enumerate(KINDS)])
    rest = base.select("doc_id", spans.alias("base"), _hidden(left, F.col(KINDS[0][0])).alias("left"), *[F.col(name).isNotNull().alias(name) for name, *_ in KINDS[1:]])
    for name, pattern, group, least in KINDS[1:]:  # what was hidden before does not match again
        rest = rest.withColumn("left", F.when(F.col(name), _hidden(F.col("left"), matches(F.col("left"), pattern, group, least))).otherwise(F.col("left")))
    found = rest.select("doc_id", "base", matches(F.col("left"), KEY, 0, LEAST).alias("found"))
    keys = F.transform(F.filter("found", lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), tests(x["value"]).alias("test")))
    tested = saved(found.select("doc_id", "base", F.filter(keys, lambda k: k["test"].isNotNull()).alias("keys")), "keys")
    uneven = unevenness(docs.select(F.col("text").alias("text")))
    each = tested.select(F.explode("keys").alias("k")).select(length_class(F.col("k.test")), rarity(F.col("k.test"), uneven).alias("rarity"))
    limits = thresholds(each)
    if not limits:
        return tested.select("doc_id", F.array_sort("base").alias("spans"))
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    taken = F.filter("keys", lambda k: F.coalesce(rarity(k["test"], uneven) >= F.element_at(table, length_class(k["test"])), F.lit(False)))
    added = F.transform(taken, lambda k: F.struct(k["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), k["end"].alias("end")))
    whole = F.concat("base", F.coalesce(added, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return tested.select("doc_id", F.array_sort(whole).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(name) for name, *_ in KINDS], F.lit(ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
