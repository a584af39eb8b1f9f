"""Tables inside blocks: pipe tables by built-in functions, HTML tables by one
Arrow UDF, and the features of their grids."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as t
from . import tokens as k


def pipe_rows(text: Column) -> Column:
    """array<array<string>>: the cells of each line with a pipe; separator lines drop out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"^`+|`+$", "")), lambda x: x.contains("|"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"\|$", ""))
    cells = F.transform(bare, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")))
    return F.filter(cells, lambda r: F.exists(r, lambda c: (c != "") & ~c.rlike(r"^[\s:-]+$")))


def is_markdown_table(text: Column) -> Column:
    """The first filled line starts with a pipe and the second has a rule."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & F.coalesce(F.get(lines, 0), F.lit("")).startswith("|") & F.coalesce(F.get(lines, 1), F.lit("")).contains("---")


def table_like(text: Column) -> Column:
    """An HTML table, a rule of dashes, colons and pipes as second line beside a
    pipe anywhere, or a pipe in the first filled line."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != "")
    ruled = (F.size(lines) >= 2) & F.coalesce(F.get(lines, 1), F.lit("")).rlike(r"^\s*[:\-\s|]+\s*$")
    return t.rlike(r"(?i)<table\b") | (t.contains("|") & (ruled | F.coalesce(F.get(lines, 0), F.lit("")).contains("|")))


def html_rows(html: Column) -> Column:
    """The same of an HTML table with plain tr, td and th, by patterns."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), t.plain))
    return F.filter(cells, lambda r: F.size(r) > 0)


def matrix(text: Column, html: Column) -> Column:
    """Rows of the HTML table if there is one, else of the pipe table, else none."""
    none = F.array().cast("array<array<string>>")
    from_html = F.when(F.lower(html).contains("<table"), html_rows(html))
    from_text = F.when(text.contains("|"), pipe_rows(text))
    return F.coalesce(F.when(F.size(from_html) > 0, from_html), F.when(F.size(from_text) > 0, from_text), none)


def canonical(rows: Column) -> Column:
    """One string that equal tables share, however spaced and cased."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.lower(F.trim(c))), " | ")), "\n")


def first_filled(row: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(row, lambda x: F.trim(x)), lambda c: c != ""), 0), F.lit(""))


def row_keys(rows: Column) -> Column:
    """First filled cell of each row under the header."""
    data = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.array_distinct(F.filter(F.transform(data, first_filled), lambda x: x != ""))


def collapsed(rows: Column) -> Column:
    """Rows with an empty first cell continue the row before; cells are padded
    where the continuation has more of them."""
    pad = lambda r, n: F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0))))

    def step(done: Column, row: Column) -> Column:
        last = F.element_at(done, -1)
        width = F.greatest(F.size(last), F.size(row))
        joined = F.zip_with(pad(last, width), F.transform(pad(row, width), lambda c, i: F.when(i == 0, "").otherwise(c)), lambda a, b: F.when(F.trim(b) == "", a).otherwise(F.concat(a, F.lit(" "), b)))
        kept = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when(F.trim(F.coalesce(F.get(row, 0), F.lit(""))) != "", F.concat(done, F.array(row))).otherwise(F.when(F.size(done) > 0, kept).otherwise(done))

    return F.aggregate(rows, F.array().cast("array<array<string>>"), step)


def size_bin(n: Column, edges: tuple[int, int]) -> Column:
    low, high = edges
    return F.when(n <= 0, "0").when(n <= low, f"<={low}").when(n <= high, f"<={high}").otherwise(f">{high}")


def signature(rows: Column) -> Column:
    """Header words (20 at most, sorted), and how many rows and columns, roughly."""
    header = F.flatten(F.transform(F.coalesce(F.get(rows, 0), F.array().cast("array<string>")), lambda c: k.labels(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1), lambda x: ~x.rlike("^[0-9]+$")))))
    n = F.greatest(F.size(rows) - 1, F.lit(0))
    wide = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.concat_ws("|", F.array_join(F.slice(F.array_sort(F.array_distinct(header)), 1, 20), " "), size_bin(n, (5, 10)), size_bin(wide, (4, 8)))


def structure_similarity(rows_a: Column, cols_a: Column, tags_a: Column, rows_b: Column, cols_b: Column, tags_b: Column) -> Column:
    """0.3 of rows' ratio, 0.3 of columns', 0.4 of tags' (multiset Jaccard; here
    ``tags`` are maps tag -> count)."""
    near = lambda a, b: F.least(a, b) / F.greatest(a, b, F.lit(1))
    names = F.array_union(F.map_keys(tags_a), F.map_keys(tags_b))
    count = lambda m, x: F.coalesce(F.element_at(m, x), F.lit(0))
    total = lambda f: F.aggregate(names, F.lit(0), lambda s, x: s + f(count(tags_a, x), count(tags_b, x)))
    return 0.3 * near(rows_a, rows_b) + 0.3 * near(cols_a, cols_b) + 0.4 * total(F.least) / F.greatest(total(F.greatest), F.lit(1))


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.heads: list[list[bool]] = []
        self.width: list[int] = []
        self.tags: dict[str, int] = {}
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "thead", "tbody", "tr", "td", "th"):
            self.tags[tag] = self.tags.get(tag, 0) + 1
        if tag == "tr":
            self.rows.append([])
            self.heads.append([])
            self.width.append(0)
        elif tag in ("td", "th"):
            if not self.rows:
                self.handle_starttag("tr", [])
            self.rows[-1].append("")
            self.heads[-1].append(tag == "th")
            span = dict(attrs).get("colspan") or "1"
            self.width[-1] += max(1, int(span)) if span.isdigit() else 1
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data


GRID = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("n_rows", T.IntegerType()), T.StructField("n_cols", T.IntegerType()), T.StructField("tags", T.MapType(T.StringType(), T.IntegerType()))])


@F.arrow_udf(GRID)
def html_grid(html: pa.Array) -> pa.Array:
    """Cells of HTML tables, with spans, breaks and nested marks: rows, the header
    row's texts, rows and columns by span, and how often each tag stands there."""

    def one(h: str | None) -> dict:
        g = _Grid()
        g.feed(h or "")
        rows = [[" ".join(c.split()) for c in r] for r in g.rows]
        head = next((r for r, th in zip(rows, g.heads, strict=True) if any(th)), [])
        return {"rows": [r for r in rows if r], "headers": head, "n_rows": len(rows), "n_cols": max(g.width, default=0), "tags": list(g.tags.items())}

    kind = pa.struct([("rows", pa.list_(pa.list_(pa.string()))), ("headers", pa.list_(pa.string())), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("tags", pa.map_(pa.string(), pa.int32()))])
    return pa.array([one(h) for h in html.to_pylist()], kind)


# ---- numeric grids: arrays of a column's numbers, null where a cell has none


def quantiles(xs: Column) -> Column:
    """Five nearest-rank quantiles, less the median, over the quartile distance."""
    s = F.array_sort(F.filter(xs, lambda x: x.isNotNull()))
    q = [F.element_at(s, (F.bround(F.lit(p) * (F.size(s) - 1)) + 1).cast("int")) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    spread = F.greatest(q[3] - q[1], F.lit(1e-9))
    return F.when(F.size(s) > 0, F.array(*[(x - q[2]) / spread for x in q])).otherwise(F.array(*[F.lit(0.0)] * 5))


def missing_rate(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x.isNull())) / F.greatest(F.size(xs), F.lit(1))


def is_index(xs: Column) -> Column:
    """Three numbers or more, whole and strictly increasing."""
    s = F.filter(xs, lambda x: x.isNotNull())
    steps = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: b > a)
    return (F.size(s) >= 3) & F.forall(s, lambda x: x == F.floor(x)) & F.forall(steps, lambda x: x)


def trend(xs: Column) -> Column:
    """(rises - falls) / (rises + falls) between neighbours that both have a number."""
    sign = F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.signum(b - a))
    total = lambda f: F.aggregate(F.filter(sign, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + f(x))
    moves = total(F.abs)
    return F.when(moves > 0, total(lambda x: x) / moves).otherwise(0.0)


def scale(xs: Column) -> Column:
    """log10 of the median absolute value, 1e-9 at least."""
    s = F.array_sort(F.transform(F.filter(xs, lambda x: x.isNotNull()), F.abs))
    n = F.size(s)
    median = (F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, F.log10(F.greatest(median, F.lit(1e-9)))).otherwise(-9.0)


def correlation_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + sum of squared differences) over the common top left block of two matrices."""
    rows = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p - q) * (p - q), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 1 / (1 + F.aggregate(rows, F.lit(0.0), lambda s, v: s + v))).otherwise(0.0)


def footprint(columns: Column) -> Column:
    """Per numeric column of a grid (array of columns): quantiles, scale, missing share, trend; and the index column."""
    one = lambda x, i: F.struct(i.alias("col"), quantiles(x).alias("quantiles"), scale(x).alias("scale"), missing_rate(x).alias("missing"), trend(x).alias("trend"), is_index(x).alias("index"))
    return F.transform(columns, one)
