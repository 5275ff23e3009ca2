"""Judges' JSON to scores: clean-up, repair, and flattening of nested rubrics, a batch of Arrow rows at a time."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions import text as T

_COMMA = re.compile(r",(\s*[}\]])")
_NEXT = re.compile(r"\S")
_MARK = re.compile(r'["\\]')
#: Keys of a dimension's object that are no sub-scores.
NOT_SCORES = ("total", "reason")

PARSED = (
    "id long, status string, correctness string, error_type string, total double, rationale string, "
    "dims array<struct<dim:string,score:double,is_na:boolean,reason:string>>"
)


def repaired(text: str) -> str:
    """Quotes inside strings get a backslash: a quote ends its string only before a colon, comma, closing bracket or the
    end. Trailing commas go."""
    out, inside, k, mark = [], False, 0, _MARK.search(text)
    while mark:
        at = mark.start()
        end = at + 1
        if mark[0] == "\\":
            end += inside
            out.append(text[k:end])
        else:
            after = _NEXT.search(text, end) if inside else None
            if after and after[0] not in ":,}]":
                out.append(text[k:at] + '\\"')
            else:
                inside = not inside
                out.append(text[k:end])
        k, mark = end, _MARK.search(text, end)
    return _COMMA.sub(r"\1", "".join(out) + text[k:])


def _number(value: object) -> float | None:
    """A finite number; anything else is none."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        number = float(value)
    except OverflowError:
        return None
    return number if math.isfinite(number) else None


def flattened(rubric: object, declared: list[str] | None = None) -> list[tuple[str, float | None, bool, str | None]]:
    """(dim, score, not applicable, reason) of each dimension. Null is not applicable; an object gives its total cut to a
    whole number or the mean of its sub-scores to the nearest even; numbers are cut; other types are left out. If as
    many dimensions have scores as were declared but under other names, the scored ones are renamed by position and the rest
    are left out."""
    if not isinstance(rubric, dict):
        return []
    found = []
    for dim, value in rubric.items():
        if value is None:
            found.append((dim, None, True, None))
        elif isinstance(value, dict):
            subs = [n for k, v in value.items() if k not in NOT_SCORES and (n := _number(v)) is not None]
            total, reason = _number(value.get("total")), value.get("reason")
            score = float(int(total)) if total is not None else float(round(sum(subs) / len(subs))) if subs else None
            found.append((dim, score, score is None, reason if isinstance(reason, str) else None))
        elif (number := _number(value)) is not None:
            found.append((dim, float(int(number)), False, None))
    scored = [row for row in found if row[1] is not None]
    if declared and {d for d, *_ in scored} != set(declared) and len(scored) == len(declared):
        return [(name, *rest) for name, (_, *rest) in zip(declared, scored, strict=True)]
    return found


def parse_one(body: str, declared: list[str] | None = None) -> dict:
    record, status = None, "ok"
    try:
        record = json.loads(body)
    except ValueError:
        status = "repaired"
        try:
            record = json.loads(repaired(body))
        except ValueError:
            record = None
    if not isinstance(record, dict):
        return {"status": "failed", "correctness": None, "error_type": None, "total": None, "rationale": None, "dims": []}
    dims = flattened(record.get("rubric"), declared)
    scores = [s for _, s, _, _ in dims if s is not None]
    total = _number(record.get("total"))
    words = {k: record[k] if isinstance(record.get(k), str) else None for k in ("correctness", "error_type", "rationale")}
    dims = [{"dim": d, "score": s, "is_na": n, "reason": r} for d, s, n, r in dims]
    return {"status": status, **words, "total": total if total is not None else sum(scores) / len(scores) if scores else 0.0, "dims": dims}


#: What rubric_rows() adds to an id.
ROW = {"dim": pa.string(), "score": pa.float64(), "is_na": pa.bool_(), "reason": pa.string(), "status": pa.string()}


def rubric_rows(raw: DataFrame, id_col: str, text_col: str, declared: list[str] | None = None) -> DataFrame:
    """id, dim, score, is_na, reason, status: one row for each dimension of each judgement, straight from its text. A judgement that
    cannot be read, or without any dimension, gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_one(body or "", declared) for body in batch.column(1).to_pylist()]
            rows = [(k, *d.values(), one["status"]) for k, one in enumerate(found) for d in one["dims"]]
            place, *columns = zip(*rows, strict=True) if rows else [()] * (1 + len(ROW))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, ROW.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *arrays], ["id", *ROW])

    body = raw.select(F.col(id_col).alias("id"), T.json_body(F.col(text_col)).alias("body"))
    return body.mapInArrow(run, f"id {body.schema['id'].dataType.simpleString()}, dim string, score double, is_na boolean, reason string, status string")


def parse_judgements(raw: DataFrame, id_col: str, text_col: str, declared: list[str] | None = None) -> DataFrame:
    """One row a judgement: id, status (ok, repaired, failed), correctness, error_type, total, rationale, dims."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [parse_one(body, declared) for body in frame["body"]]
            yield pd.DataFrame({"id": frame["id"], **{k: [r[k] for r in rows] for k in ("status", "correctness", "error_type", "total", "rationale", "dims")}})

    return raw.select(F.col(id_col).cast("long").alias("id"), T.json_body(F.col(text_col)).alias("body")).mapInPandas(run, PARSED)


def safe_arguments(text: Column) -> Column:
    """A tool call's arguments as JSON text; the raw text as a JSON string where it is no JSON; {} for null and empty."""
    raw = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("{}"))
    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.regexp_extract(F.to_json(F.struct(raw.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1))


def parse_variant(text: Column) -> Column:
    """JSON text as VARIANT, null where it is none: for paths whose order does not matter, inside code generation."""
    return F.try_parse_json(text)


def at_path(text: Column, path: str) -> Column:
    """The string at a path like $.a.b[0].c; null on any miss."""
    return F.get_json_object(text, path)


def answer_of(text: Column) -> Column:
    """A runner's answer: its answer, text or output field, or the text itself if that is no object."""
    fields = F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in ("answer", "text", "output")))
    return T.strip(F.when(T.strip(text).startswith("{"), F.coalesce(fields, F.lit(""))).otherwise(text))
