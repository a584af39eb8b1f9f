"""The protocol with an external labeller: blobs, prompts per batch, replies,
their normal form, token sums, and the judge's prompt and verdicts.

A model is any function over prompts (``Model``); it runs in ``mapInPandas``, so
each task calls it for its own prompts. Prompts and replies are rows, and all
that a batch holds is bounded by its number of pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KINDS, LABELS

#: prompt (a list of them) -> a reply each: text, prompt tokens, completion tokens.
Model = Callable[[list[str]], list[tuple[str, int, int]]]
REPLY = "reply string, prompt_tokens long, completion_tokens long"
FAILED = "Failed to parse LLM output"
# Fields of a reply, and labels that a judge may give.
FIELDS = ["pair_key", "change_type", "change_description", "description", "confidence", "row_changes"]
JUDGE_LABELS = ["Major", "Minor", "No Change", "Skipped", "New", "Deleted"]


def known_kind(kind: Column) -> Column:
    """Kinds that no classifier knows count as text."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin(*KINDS), k).otherwise("text")


def blob(kind: Column, text: Column, html: Column) -> Column:
    """What a model sees of one side: tables their HTML, images what is written on them."""
    text, html = F.coalesce(text, F.lit("")), F.coalesce(html, F.lit(""))
    return F.when(kind == "table", F.concat(F.lit("TABLE_RAW:\n"), html, F.lit("\n"))).when(kind == "image", F.concat(F.lit("IMAGE_TEXT: "), text)).otherwise(text)


def rule_list(rules: list[str]) -> str:
    return "".join(f"\n- {r}" for r in rules)


def prompts(batched: DataFrame, rules: dict[str, list[str]], by: list[str]) -> DataFrame:
    """by, pair_keys, prompt: one per batch (columns ``by``) of pairs (pair_key,
    kind, row_id, left_blob, right_blob, place), the pairs in order of ``place``."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    line = lambda name, value: F.concat(F.lit(name), value, F.lit("\n"))
    one = F.concat(line("PAIR_KEY: ", quoted("pair_key")), line("KIND: ", quoted("kind")), line("ROW_ID: ", quoted("row_id")), F.lit("---\nVersion A:\n"), F.coalesce("left_blob", F.lit("")), F.lit("\n---\nVersion B:\n"), F.coalesce("right_blob", F.lit("")), F.lit("\n---"))
    told = "".join(f"{name.upper()} RULES:{rule_list(rules.get(name, []))}\n\n" for name in ("major", "minor", "no change"))
    answer = f"Answer with a JSON array, one object per pair, with the fields {', '.join(FIELDS)}; change_type is one of: {', '.join(LABELS)}."
    rows = batched.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "pair_key", one.alias("pair")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["pair"]), "\n\n")
    return rows.select(*by, F.transform("rows", lambda r: r["pair_key"]).alias("pair_keys"), F.concat(F.lit(f"{told}{answer}\n\n"), body).alias("prompt"))


def called(asked: DataFrame, model: Model) -> DataFrame:
    """``asked`` (with ``prompt``) and the model's reply and tokens to each."""
    schema = T.StructType([*asked.schema.fields, *T._parse_datatype_string(REPLY).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = model(f["prompt"].tolist()) if len(f) else []
            yield f.assign(reply=[r for r, _, _ in replies], prompt_tokens=[int(p) for _, p, _ in replies], completion_tokens=[int(c) for _, _, c in replies])

    return asked.mapInPandas(run, schema)


def _loaded(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def salvaged(reply: str | None) -> list | None:
    """The array in a reply: all of it without its code fence, else from the first
    bracket to the last, else of the objects that stand in it; null if none."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (reply or "").strip(), flags=re.I)).strip("` \n\r\t")
    found = _loaded(text) if text[:1] in ("[", "{") else None
    if found is None and "[" in text and text.rfind("]") > text.find("["):
        found = _loaded(text[text.find("[") : text.rfind("]") + 1])
    if found is None:
        objects, depth, start = [], 0, 0
        for at, c in enumerate(text):
            if c == "{":
                start = at if not depth else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    objects.append(text[start : at + 1])
        found = _loaded(f"[{','.join(objects)}]") if objects else None
    return found if isinstance(found, list) else None


def first_object(reply: str | None) -> dict | None:
    """From the first opening to the last closing brace, if that is an object."""
    text = reply or ""
    found = _loaded(text[text.find("{") : text.rfind("}") + 1]) if "{" in text else None
    return found if isinstance(found, dict) else None


_RESULT = T.ArrayType(T.StructType([T.StructField("pair_key", T.StringType()), T.StructField("change_type", T.StringType()), T.StructField("change_description", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("row_changes", T.StringType())]))


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


@F.arrow_udf(_RESULT)
def results(replies: pa.Array, keys: pa.Array) -> pa.Array:
    """Of each reply its results, normalised: a description under either name,
    row_changes as JSON ([] if missing). All pairs of a reply that holds no array are Unidentified."""

    def one(reply: str | None, asked: list[str] | None) -> list[dict]:
        items = salvaged(reply)
        if items is None:
            return [{"pair_key": k, "change_type": "Unidentified", "change_description": FAILED, "confidence": None, "row_changes": "[]"} for k in asked or []]
        out: dict[str, dict] = {}
        for x in items:
            key = str(x.get("pair_key") or "") if isinstance(x, dict) else ""
            if key:
                told = x.get("change_description", x.get("description"))
                kind = x.get("change_type")
                out[key] = {"pair_key": key, "change_type": None if kind is None else str(kind), "change_description": None if told is None else str(told), "confidence": _number(x.get("confidence")), "row_changes": json.dumps(x.get("row_changes", []))}
        return list(out.values())

    kind = pa.list_(pa.struct([("pair_key", pa.string()), ("change_type", pa.string()), ("change_description", pa.string()), ("confidence", pa.float64()), ("row_changes", pa.string())]))
    return pa.array([one(r, k) for r, k in zip(replies.to_pylist(), keys.to_pylist(), strict=True)], kind)


def labelled(replied: DataFrame) -> DataFrame:
    """pair_key, change_type, change_description, confidence, row_changes of all
    pairs asked for; those that the reply leaves out, or gives no known label,
    are Unidentified."""
    asked = replied.select(F.explode("pair_keys").alias("pair_key")).distinct()
    told = replied.select(F.inline(results("reply", "pair_keys"))).groupBy("pair_key").agg(F.min(F.struct("change_type", "change_description", "confidence", "row_changes")).alias("r")).select("pair_key", "r.*")
    out = asked.join(told, "pair_key", "left")
    label = F.when(F.col("change_type").isin(*LABELS), F.col("change_type")).otherwise("Unidentified")
    return out.select("pair_key", label.alias("change_type"), F.coalesce("change_description", F.lit("No result")).alias("change_description"), "confidence", F.coalesce("row_changes", F.lit("[]")).alias("row_changes"))


def token_sums(replied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens of prompts, of completions and of both."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = replied.groupBy(*(by or [])).agg(total("prompt_tokens"), total("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def judge_prompts(pairs: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """``pairs`` (left_text, right_text, change_type) with ``prompt``: is the label
    right, by the first two major rules, the first minor and the first no-change rule?"""
    told = f"MAJOR RULES:{rule_list(rules.get('major', [])[:2])}\nMINOR RULES:{rule_list(rules.get('minor', [])[:1])}\nNO CHANGE RULES:{rule_list(rules.get('no change', [])[:1])}\n"
    answer = f'Answer with one JSON object: change_type (one of {", ".join(JUDGE_LABELS)}), score (0 to 1), reason, confidence (0 to 1).'
    side = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.withColumn("prompt", F.concat(F.lit(f"Is the predicted change type right?\n{told}Original:\n"), side("left_text"), F.lit("\nRevised:\n"), side("right_text"), F.lit("\nPredicted: "), side("change_type"), F.lit(f"\n{answer}")))


@F.arrow_udf(T.StructType([T.StructField("judged_type", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())]))
def verdicts(replies: pa.Array) -> pa.Array:
    """A judge's label, score and reason; a reply without an object has score -1."""

    def one(reply: str | None) -> dict:
        x = first_object(reply)
        if x is None:
            return {"judged_type": None, "score": -1.0, "reason": "no JSON object"}
        text = lambda v: None if v is None else str(v)
        return {"judged_type": text(x.get("change_type")), "score": _number(x.get("score")) or 0.0, "reason": text(x.get("reason"))}

    return pa.array([one(r) for r in replies.to_pylist()], pa.struct([("judged_type", pa.string()), ("score", pa.float64()), ("reason", pa.string())]))


def judged_pairs(pairs: DataFrame, rules: dict[str, list[str]], model: Model) -> DataFrame:
    """pairs with judged_type, score and reason. Trivial labels (New, Deleted, No
    Change, Skipped) are accepted without a call, with score 1."""
    sure = F.col("change_type").isin("New", "Deleted", "No Change", "Skipped")
    easy = pairs.where(sure).select("*", F.col("change_type").alias("judged_type"), F.lit(1.0).alias("score"), F.lit("accepted").alias("reason"))
    asked = called(judge_prompts(pairs.where(~F.coalesce(sure, F.lit(False))), rules), model)
    hard = asked.withColumn("verdict", verdicts("reply")).select(*pairs.columns, "verdict.*")
    return easy.unionByName(hard)
