"""Reports: counts by kind, flat rows for spreadsheets, Markdown and HTML."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def kind_counts(pairs: DataFrame) -> DataFrame:
    """kind, requirements, and how many have the same content throughout."""
    per = pairs.groupBy("kind", "document", "row_idx").agg(F.bool_and(F.col("change_type") == "No Change").alias("same"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("requirements"), F.count_if("same").alias("identical"))


def flat(pairs: DataFrame) -> DataFrame:
    """A change log as plain columns: what a spreadsheet takes."""
    return pairs.select("document", "row_idx", "kind", "pair_key", "change_type", "change_description", t.normal_scalar(F.col("left_page").cast("string")).alias("source_page"), t.normal_scalar(F.col("right_page").cast("string")).alias("target_page"))


def row_label(key: Column) -> Column:
    """The readable last part of a pair key, 120 characters at most."""
    last = F.element_at(F.filter(F.split(key, r"\|\|"), lambda p: F.trim(p) != ""), -1)
    return F.substring(F.trim(F.replace(F.coalesce(last, key), F.lit("_"), F.lit(" "))), 1, 120)


def content_differs(a_text: Column, a_table: Column, b_text: Column, b_table: Column) -> Column:
    flat_ = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    tables = (F.coalesce(a_table, F.lit("")) != "") | (F.coalesce(b_table, F.lit("")) != "")
    return F.when(tables, flat_(a_table) != flat_(b_table)).otherwise(flat_(a_text) != flat_(b_text))


def markdown_cells(rows: Column) -> Column:
    """A matrix as a Markdown table."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, 0))))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, 0)), rule), body), "\n"))


def html_cells(rows: Column) -> Column:
    """A matrix as an HTML table."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td"))), ""), F.lit("</table>"))


def markdown(pairs: DataFrame) -> DataFrame:
    """document, row_idx, section: one Markdown section per requirement."""
    one = F.concat(F.lit("### "), F.col("pair_key"), F.lit("\n\n**"), F.col("change_type"), F.lit("** "), F.coalesce("change_description", F.lit("")), F.lit("\n\n| before | after |\n|---|---|\n| "), F.coalesce(t.squeeze(F.col("left_text")), F.lit("")), F.lit(" | "), F.coalesce(t.squeeze(F.col("right_text")), F.lit("")), F.lit(" |"))
    return pairs.groupBy("document", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("va", one.alias("s")))), lambda x: x["s"]), "\n\n").alias("section"))


def summary_page(counts: DataFrame, title: str = "Changes") -> str:
    """The summary (kind, change_type, n: a few rows) as an HTML page."""
    rows = "".join(f"<tr><td>{html.escape(str(r['kind']))}</td><td>{html.escape(str(r['change_type']))}</td><td>{r['n']}</td></tr>" for r in counts.orderBy("kind", "change_type").collect())
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr><th>kind</th><th>change</th><th>items</th></tr>{rows}</table>"


def write_mapping(wide: DataFrame, path: str, form: str = "csv") -> None:
    wide.write.option("header", True).format(form).save(path)


def write_trace(nested: DataFrame, path: str) -> None:
    nested.write.json(path)
