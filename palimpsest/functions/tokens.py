"""Features of token lists: arrays in, arrays or numbers out, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a token a value and not a label.
VALUE = r"^(0x[0-9a-f]+|[0-9]+(/[0-9]+)+|[0-9]+(\.[0-9]+)+|[0-9a-f]{2,}|byte|bytes|kb|mb|gb|ms|s|sec|hz|%|[+/-])$"
NUMERIC = [r"0x[0-9a-f]+", r"[0-9]+(?:/[0-9]+)+", r"[0-9]+(?:\.[0-9]+)+", r"[0-9a-f]{2,}"]
STANDARD = r"(?i)\b(?:GB|GB/T|QC/T|QC-T|CNCA-[A-Za-z0-9-]+|MIIT|EIDC|CVTSC)[^\s,;)]{0,20}?[0-9]{2,4}(?:-[0-9]{2,4})?\b"
STOP_EXEMPT = r"^(0x[0-9a-f]+|[0-9a-f/.]+)$"


def shingles(t: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; none if there are fewer."""
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def simhash(t: Column) -> Column:
    """64 low bits of each token's MD5 vote; a bit is set at a tie or above. No
    token: 0. As a signed long."""
    low = lambda x: F.shiftleft(F.conv(F.substring(F.md5(x.cast("binary")), 17, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(F.md5(x.cast("binary")), 25, 8), 16, 10).cast("long"))
    hashes = F.transform(t, low)
    bit = lambda i: F.when(F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, F.lit(i)).cast("int") * 2 - 1) >= 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    total = bit(0)
    for i in range(1, 64):
        total = total.bitwiseOR(bit(i))
    return F.when(F.size(t) > 0, total).otherwise(F.lit(0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) / 64.0


def values(t: Column) -> Column:
    return F.filter(t, lambda x: F.lower(x).rlike(VALUE))


def labels(t: Column) -> Column:
    return F.filter(t, lambda x: ~F.lower(x).rlike(VALUE))


def numeric_tokens(text: Column) -> Column:
    """Distinct: hexadecimal, slashed and dotted numbers, runs of hexadecimal
    letters (also inside words), and standards' codes."""
    found = [F.regexp_extract_all(text, F.lit(f"(?i)({p})"), 1) for p in NUMERIC]
    return F.array_distinct(F.concat(*found, standard_codes(text)))


def standard_codes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(STANDARD), 0), F.lower)


def is_heading(t: Column, raw: Column) -> Column:
    alphabetic = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}+$")))
    few = (F.size(t) <= 6) & (alphabetic >= F.greatest(F.lit(1), F.size(t) - 1))
    return (F.size(t) > 0) & (raw.rlike(r"^\s*[0-9]+(?:\.[0-9]+)*\b") | few)


def prefixes(t: Column) -> Column:
    """Letters before a digit in tokens with digits, 2 to 10 of them."""
    return F.array_distinct(F.filter(F.transform(t, lambda x: F.regexp_extract(x, r"^([a-z]{2,10})[^a-z]*[0-9]", 1)), lambda x: x != ""))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.size(F.array_union(a, b))


def distinct(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def dice(a: Column, b: Column) -> Column:
    return 2 * shared(a, b) / F.greatest(F.lit(1), distinct(a) + distinct(b))


def jaccard(a: Column, b: Column) -> Column:
    return shared(a, b) / F.greatest(F.lit(1), union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other has."""
    return shared(a, b) / F.greatest(F.lit(1), F.least(distinct(a), distinct(b)))


def cover(a: Column, b: Column) -> Column:
    """Share of the first set that the second has."""
    return shared(a, b) / F.greatest(F.lit(1), distinct(a))


def same_set(a: Column, b: Column) -> Column:
    """Equal and not empty."""
    return (distinct(a) > 0) & (distinct(a) == distinct(b)) & (shared(a, b) == distinct(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def hashed_bag(t: Column, buckets: int = 256) -> Column:
    """Counts per hash bucket, scaled to length 1."""
    at = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def entities(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]{1,6})\b"), 1)))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def lineified(text: Column) -> Column:
    """The lines of recognised text. Without line breaks, the first of these that
    gives two parts or more: label and number pairs, parts between wide spaces,
    between dashes or semicolons, between pipes; else the whole."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)```+[\w-]*", " "), r"(?i)\bmarkdown\b", " "))
    parts = lambda pattern: F.filter(F.transform(F.split(s, pattern), lambda x: F.trim(x)), lambda x: x != "")
    several = lambda found: F.when(F.size(found) >= 2, found)
    pair = r"([A-Za-z&/ \-]{2,60}?)\s*:?\s*([0-9]{1,4}%?)"
    label, number = (F.regexp_extract_all(s, F.lit(pair), i) for i in (1, 2))
    both = F.filter(F.zip_with(label, number, lambda a, b: F.when(F.trim(a) != "", F.concat(F.trim(a), F.lit(": "), b))), lambda x: x.isNotNull())
    pairs = F.when((F.size(label) >= 2) & (F.size(both) > 0), both)
    found = F.when(s.contains("\n"), parts(r"\r?\n")).otherwise(F.coalesce(pairs, several(parts(r"\s{2,}")), several(parts(r" - |;")), several(parts(r"\|")), F.array(s)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(found)


def line_set_jaccard(a: Column, b: Column, key) -> Column:
    """Jaccard similarity of two arrays of lines by ``key`` of each; 0 without any."""
    keyed = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), key), lambda k: k != ""))
    x, y = keyed(a), keyed(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def atoms(text: Column) -> Column:
    """Per line the codes in it and their ordered pairs, lower-cased, sorted."""

    def of_line(line: Column) -> Column:
        codes = F.regexp_extract_all(line, F.lit(r"\b([A-Z][A-Z0-9]{1,6})\b"), 1)
        rest = lambda i: F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0)))
        pairs = F.flatten(F.transform(codes, lambda x, i: F.transform(rest(i), lambda y: F.concat_ws(" ", x, y))))
        return F.concat(codes, pairs)

    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(lines(text), of_line)), F.lower)))


def line_bag(text: Column) -> Column:
    """Lines without parentheses, and the parts that connectives separate."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\([^)]*\)", " "), r"\s+", " "))

    def of_line(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(clean(line), r"\s*(?:&|/|\+|,|;|\band\b)\s*"), lambda x: F.trim(x)), lambda p: p != "")
        return F.concat(F.array(clean(line)), parts, F.when(F.size(parts).between(2, 3), F.array(F.array_join(parts, " "))).otherwise(F.array().cast("array<string>")))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(lines(text), of_line)), lambda x: F.length(x) >= 2)))


def summary(text: Column) -> Column:
    """The first line and up to 8 capitalised codes, 240 characters at most."""
    head = F.get(lines(text), 0)
    caps = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b"), 1))), 1, 8)
    full = F.when(F.size(caps) > 0, F.concat(head, F.lit(" — shows: "), F.array_join(caps, ", "))).otherwise(head)
    return F.coalesce(F.substring(full, 1, 240), F.lit(""))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)


def numeric_density(text: Column) -> Column:
    t = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    return F.size(F.filter(t, lambda x: x.rlike("[0-9]"))) / F.greatest(F.lit(1), F.size(t))
