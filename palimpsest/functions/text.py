"""Normalisation of text as Column expressions.

Each normal form is a list of steps (pattern, replacement) in a syntax that
Java's regex engine and RE2 share, applied in order inside whole-stage codegen.
``spark_steps`` turns a list into a Column, ``sql_steps`` into the same chain
for DuckDB. Where the behaviour wanted needs look-around, the step captures
both sides and stands twice, which is equal: after the first pass no two
matches share a character any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Steps = list[tuple[str, str]]

# Mojibake sequences and what they stand for, replaced in this order.
MOJIBAKE = [
    ("â—", "•"), ("â€¢", "•"), ("âž”", "•"), ("Â", ""), ("â€“", "-"), ("â€”", "-"), ("â€˜", "'"), ("â€™", "'"),
    ("â€œ", '"'), ("â€", '"'), ("â€¦", "..."), ("Ã—", "×"), ("âˆ’", "-"), ("â„¢", "™"), ("â‚‚", "₂"),
]
# The same for recognised image text.
MOJIBAKE_OCR = [
    ("Â°", "°"), ("â‰¤", "≤"), ("â‰¥", "≥"), ("â€“", "–"), ("â€”", "—"), ("â€¢", "•"), ("â€˜", "‘"), ("â€™", "’"),
    ("â€œ", "“"), ("â€", "”"), ("â€¦", "…"), ("Â±", "±"), ("Â·", "·"), ("Â®", "®"), ("Â©", "©"),
]
# Page furniture that line sources drop.
HEADER_LINES = [r"Page:\s*\d+\s+of\s+\d+", r"ECCN:\s*", r"Release Date:\s*", r"Cadence:\s*", r"Group:\s*"]
# Endings of media files; words of which a footer table has three.
MEDIA = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".wmf", ".svg", ".mp4", ".avi", ".mov", ".webm"]

TAGS: Steps = [(r"(?is)<\s*sup\b[^>]*>(.*?)</\s*sup\s*>", r"\1"), (r"(?i)<\s*br\s*/?\s*>", " "), (r"<[^>]+>", " ")]
MATH: Steps = [(r"\$[^$]*\$", " "), (r"\\[a-zA-Z]+(\s*\{[^{}]*\})?", " "), (r"[{}]", " ")]
UNITS: Steps = [(r"<\s*=", "<="), (r">\s*=", ">="), (r"\s*~\s*", " "), (r"\b(km)\s*/\s*(h)\b", r"\1/h"), (r"\b(m)\s*/\s*(s)\b", r"\1/s")]
DIGITS: Steps = [(r"([0-9])\s+([0-9])", r"\1\2")] * 2
PERCENT: Steps = [(r"\s*\\?%\b", "%")]

#: From text with mojibake, entities and compatibility forms already undone, to lower-cased words, numbers and a few signs.
BEFORE_LOWER: Steps = [*TAGS, ("[–—]", "-"), (r"[•·●○►➤➔→|\t;]", " "), (r"\s*[\r\n]+\s*", " ")]
AFTER_LOWER: Steps = [
    ("```markdown", " "), (r"[*_~#`]", " "), (r"-{2,}", " "), *MATH, *UNITS, *DIGITS, *PERCENT,
    *[(r"([a-z])-+([a-z])", r"\1 \2")] * 2, (r"[^\p{L}\p{N}\s:/+.%<=>-]", " "), (r"\s+", " "),
]
#: Numbers, dotted and slashed ones too, that no letter or digit touches.
NUMBERS: Steps = [(r"(^|[^\p{L}\p{N}_])[0-9]+(?:[./][0-9]+)*($|[^\p{L}\p{N}_])", r"\1<num>\2")] * 2

MARKDOWN: Steps = [
    (r"(?is)```[^\n]*\n(.*?)```", r"\1"), (r"`+([^`]+?)`+", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"),
    (r"__(.+?)__", r"\1"), (r"_(.+?)_", r"\1"), (r"~~(.+?)~~", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""),
]
#: What two versions are compared by: letters, digits and a few signs, however formatted.
CONTENT: Steps = [
    *MARKDOWN, (r"(?i)<br\s*/?>", " "), (r"<[^>]+>", " "), (r"\s*\|\s*", " "), *DIGITS, (r"<\s*=", "<="), (r">\s*=", ">="),
    (r"(?i)\b(km)\s*/\s*(h)\b", r"\1/h"), (r"(?i)\b(m)\s*/\s*(s)\b", r"\1/s"), (r"[^0-9a-zA-Z\s/%+<>=-]", " "), (r"\s+", " "),
]
#: A text without any of these is changed by DIGITS (where CONTENT_GAP is found) and the last two steps of CONTENT only:
#: every other step needs one, and none brings one in. CONTENT_REST is those two steps in one.
CONTENT_MARKS, CONTENT_GAP = r"[`*_~#<>|/]", r"[0-9]\s+[0-9]"
CONTENT_REST: Steps = [(r"[^0-9a-zA-Z/%+<>=-]+", " ")]
PLAIN: Steps = [(r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "), (r"\s+", " ")]
OCR: Steps = [
    (r"(?i)```+[\w-]*", " "), (r"(?i)\bmarkdown\b", " "), ("&amp;", "&"), (r"[*_`]+", ""), (r"[•·●◦]+", " "), (r" \+ ", " & "), (r"\+", " & "),
    (r"[|]+", " "), (r"[–—-]{2,}", " - "), (r"(?i)\b(if\s+present|depending\s+on\s+vehicle\s+variant|case\s+[0-9]+:?|example\s+of\s+intervention\s+profile)\b", " "), (r"\s+", " "),
]
LINE: Steps = [(r"(?i)```+[\w-]*", ""), (r"^[#*•·\s-]+", ""), (r"(?i)\bmarkdown\b", ""), (" & ", " and "), (r"[.,:;()\[\]\"']", ""), (r"\s+", " ")]


def spark_steps(c: Column, steps: Steps) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to.replace("\\", "$"))
    return c


def sql_steps(c: str, steps: Steps) -> str:
    for pattern, to in steps:
        quoted = [x.replace("'", "''") for x in (pattern, to)]
        c = f"regexp_replace({c}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return c


def spark_replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sql_replace(c: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


@F.arrow_udf(T.StringType())
def unfold(texts: pa.Array) -> pa.Array:
    """Compatibility forms (NFKC) and, after that, mojibake and HTML entities
    undone: what no built-in function does."""
    import html
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t)
            for a, b in MOJIBAKE:
                t = t.replace(a, b)
        return html.unescape(t) if "&" in t else t

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def composed(texts: pa.Array) -> pa.Array:
    """NFC."""
    import unicodedata

    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


#: A digit that may begin what NUMBERS replaces. HYPHEN and CLEAN_REST are the hyphens and the last two steps of
#: AFTER_LOWER, each as one that starts at the character it is about; single spaces, which would stay, are not matched.
NUMBER_AT = r"[0-9](?<![\p{L}\p{N}_][0-9])"
HYPHEN: Steps = [("-(?<=[a-z]-)-*(?=[a-z])", " ")]
CLEAN_REST: Steps = [(r"(?:[^ a-z\p{L}\p{N}:/+.%<=>-]| (?=[^a-z\p{L}\p{N}:/+.%<=>-]))[^a-z\p{L}\p{N}:/+.%<=>-]*", " ")]


def staged(c: Column, stages: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> Column:
    """One after another (condition, change), each made only of a text of which the condition
    holds. As a fold over the stages' numbers, where each text is made once, not nested."""

    def one(x: Column, n: Column) -> Column:
        out = None
        for i, (found, change) in enumerate(stages):
            case = (n == i) & found(x)
            out = F.when(case, change(x)) if out is None else out.when(case, change(x))
        return out.otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(len(stages))]), c, one)


def _has(signs: str, steps: Steps) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Steps for texts with any of these characters."""
    return lambda x: reduce(Column.__or__, [x.contains(sign) for sign in signs]), lambda x: spark_steps(x, steps)


_ALL = lambda x: F.lit(True)
_GAPS = (lambda x: x.rlike(CONTENT_GAP), lambda x: spark_steps(x, DIGITS))
#: What an already clean text may need again, in order.
_AGAIN = [_has("<>", UNITS[:2]), _has("/", UNITS[3:]), _GAPS, _has("%", PERCENT), _has("-", HYPHEN)]
_CLEAN = [
    (lambda x: x.contains("â") | x.contains("Â") | x.contains("Ã"), lambda x: spark_replace(x, MOJIBAKE)),
    _has("<", TAGS), (_ALL, lambda x: F.lower(spark_steps(x, BEFORE_LOWER[3:5]))),
    (lambda x: x.rlike(r"[*_~#`$\\{}]|--"), lambda x: spark_steps(x, AFTER_LOWER[:6])),
    *_AGAIN, (_ALL, lambda x: F.trim(spark_steps(x, CLEAN_REST))),
]
_NORMAL = [*_CLEAN, (lambda x: x.rlike(NUMBER_AT), lambda x: spark_steps(x, NUMBERS))]
_TWICE = [*_NORMAL, _has("<", TAGS), (lambda x: x.contains("--"), lambda x: spark_steps(x, AFTER_LOWER[2:3])), *_AGAIN, (_ALL, lambda x: F.trim(spark_steps(x, [("  +", " ")])))]


def clean(c: Column) -> Column:
    """Lower-cased words of matching, numbers kept; ``unfold`` comes before it
    where the text may hold entities or compatibility forms. The steps are those of
    BEFORE_LOWER and AFTER_LOWER, left out where a text has nothing for them; line ends
    and tildes become spaces by later steps too."""
    return staged(F.coalesce(c, F.lit("")), _CLEAN)


def normal(c: Column) -> Column:
    return staged(F.coalesce(c, F.lit("")), _NORMAL)


def text_clean(c: Column) -> Column:
    """What matching compares: normalised twice, which drops the number marks
    (they look like tags), so it is free of numbers that stand alone. What is clean
    has no mojibake, capitals, line ends or signs left, so the second time does less."""
    return staged(F.coalesce(c, F.lit("")), _TWICE)


def sql_clean(c: str) -> str:
    c = sql_steps(sql_replace(f"coalesce({c}, '')", MOJIBAKE), BEFORE_LOWER)
    return f"trim({sql_steps(f'lower({c})', AFTER_LOWER)})"


def sql_normal(c: str) -> str:
    return sql_steps(sql_clean(c), NUMBERS)


def sql_text_clean(c: str) -> str:
    return sql_clean(sql_normal(c))


def tokens(c: Column) -> Column:
    """Words of a text that ``text_clean`` made."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def content(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    short = F.when(c.rlike(CONTENT_GAP), spark_steps(c, [*DIGITS, *CONTENT_REST])).otherwise(spark_steps(c, CONTENT_REST))
    return F.lower(F.trim(F.when(c.rlike(CONTENT_MARKS), spark_steps(c, [*CONTENT[:-2], *CONTENT_REST])).otherwise(short)))


def sql_content(c: str) -> str:
    return f"lower(trim({sql_steps(f'coalesce({c}, {chr(39)}{chr(39)})', CONTENT)}))"


def plain(c: Column) -> Column:
    return F.trim(spark_steps(c, PLAIN))


def squeeze(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def ocr(c: Column) -> Column:
    return F.trim(spark_steps(spark_replace(c, MOJIBAKE_OCR), OCR))


def line_key(c: Column) -> Column:
    return F.lower(F.trim(spark_steps(F.trim(c), LINE)))


def is_header_line(c: Column, patterns: list[str] | None = None) -> Column:
    return c.rlike("(?i)^(?:" + "|".join(patterns or HEADER_LINES) + ")")


def is_media(c: Column) -> Column:
    low = F.lower(c)
    found = low.contains(MEDIA[0])
    for m in MEDIA[1:]:
        found = found | low.contains(m)
    return F.coalesce(found, F.lit(False))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def is_footer_table(html: Column, keywords: list[str], least: int = 3) -> Column:
    """A table that holds ``least`` of the keywords."""
    n = F.lit(0)
    for k in keywords:
        n = n + F.lower(html).contains(k.lower()).cast("int")
    return F.lower(html).contains("<table") & (n >= least)


def diagnostic_id(c: Column) -> Column:
    """The first hexadecimal id after IO DID, else after DID; null if none."""
    up = F.upper(c)
    first = F.regexp_extract(up, r"IO\s*DID\s*[:-]?\s*([0-9A-F]{3,4})", 1)
    second = F.regexp_extract(up, r"DID\s*[:-]?\s*([0-9A-F]{3,4})", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def to_number(c: Column) -> Column:
    """A table cell as a number, or null: NA marks, footnote signs, spaces and
    thousands commas are allowed."""
    t = F.lower(F.trim(c))
    t = F.trim(F.regexp_replace(t, r"[*#@]+$", ""))
    t = F.regexp_replace(t, r"[,\s\u00a0]", "")
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.expr("1")).cast("double") * t.try_cast("double")


def multiplier(header: Column) -> Column:
    """What a column header says its numbers are multiplied by."""
    h = F.lower(F.coalesce(header, F.lit("")))
    zeros = F.length(F.regexp_extract(h, r"\((0+)\)", 1))
    return F.when(h.rlike(r"billion|\bbn\b"), 1e9).when(h.rlike(r"million|\bmn\b|\bm\b"), 1e6).when(h.rlike(r"thousand|\bk\b"), 1e3).when(zeros > 0, F.pow(F.lit(10.0), zeros)).otherwise(1.0)


def image_path(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.when(~is_blank(c), F.concat(F.lit("images/"), F.regexp_replace(base, r"^[./\\]+", "")))


def base_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def core_requirement(c: Column) -> Column:
    """The first part between full stops and semicolons that obliges, else 200 characters."""
    parts = F.filter(F.transform(F.split(c, r"[.;]"), lambda x: F.trim(x)), lambda p: F.lower(p).rlike(r"shall|must|should|require"))
    return F.coalesce(F.get(parts, 0), F.substring(c, 1, 200))


def normal_scalar(c: Column) -> Column:
    """Page and order numbers out of text: "0.0" is 1, blank stays blank, any
    other number its whole absolute value, the rest blank."""
    t = F.trim(c)
    return F.when(t == "0.0", "1").otherwise(F.coalesce(F.abs(t.try_cast("double")).cast("long").cast("string"), F.lit("")))
