"""Text functions as Column expressions: normalisation, matching, labels, keywords and clean-up."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Punctuation that normalisation drops, rules for error types, characters no keyword holds.
PUNCTUATION = r"""[，。！？；：、“”‘’（）【】《》,.!?;:"'()\[\]{}<>·…—\-+/\\|*`~@#$%^&=]"""
ERROR_RULES = (
    ("事实", "事实错误"), ("计算", "计算错误"), ("逻辑", "逻辑缺失"), ("不完整", "不完整"), ("遗漏", "不完整"), ("指令", "指令偏离"),
    ("跑题", "指令偏离"), ("偏题", "指令偏离"), ("风险", "含风险内容"), ("安全", "含风险内容"), ("有害", "含风险内容"),
)
UNCLASSIFIED = "未归类"
STOP_CHARACTERS = "的了是我你他她它们这那有就和也都还啊吧呢吗呀把被让给跟与在到上下里外中以及为会能可要对一不是"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; null gives an empty text."""
    return F.regexp_replace(filled(text), r"(?U)^\s+|\s+\z", "")


def normalize(text: Column) -> Column:
    """Lower case without white space and punctuation; null gives an empty text."""
    return F.regexp_replace(F.regexp_replace(F.lower(filled(text)), r"(?U)\s+", ""), PUNCTUATION, "")


def characters(text: Column) -> Column:
    """The characters of the normalised text; an empty text has none."""
    plain = normalize(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, ""))


def exact_match(a: Column, b: Column) -> Column:
    return (normalize(a) == normalize(b)).cast("double")


@F.pandas_udf(DoubleType())
def _shared_characters(p: pd.Series, r: pd.Series) -> pd.Series:
    """How many characters two texts share as multisets."""
    return pd.Series([float((Counter(a) & Counter(b)).total()) for a, b in zip(p, r, strict=True)])


def character_f1(a: Column, b: Column) -> Column:
    """F1 of the two multisets of normalised characters; 0 if either is empty or nothing is shared."""
    p, r = normalize(a), normalize(b)
    return F.when((p == "") | (r == ""), 0.0).otherwise(2.0 * _shared_characters(p, r) / (F.length(p) + F.length(r)))


def objective_label(exact: Column, f1: Column) -> Column:
    return F.when((exact == 1.0) | (f1 >= 0.85), "right").when(f1 >= 0.4, "partial").otherwise("wrong")


def error_label(error_type: Column) -> Column:
    """The label of the first rule whose word occurs; unknown types stay, missing ones are unclassified."""
    out = F.when(filled(error_type) == "", UNCLASSIFIED)
    for word, label in ERROR_RULES:
        out = out.when(F.contains(error_type, F.lit(word)), label)
    return out.otherwise(error_type)


def top_bigrams(text: Column, most: int) -> Column:
    """A text's most frequent pairs of neighbouring characters, after dropping white space, punctuation and underscores, that hold no
    stop character; ties alphabetically."""
    stop = str.maketrans(dict.fromkeys(STOP_CHARACTERS, "\n"))

    @F.pandas_udf(ArrayType(StringType()))
    def top(plain: pd.Series) -> pd.Series:
        def of(whole: str) -> list[str]:
            counts = Counter(a + b for part in whole.translate(stop).split("\n") for a, b in zip(part, part[1:], strict=False))
            return [g for _, g in heapq.nsmallest(most, ((-n, g) for g, n in counts.items()))]

        return plain.map(of)

    return top(F.regexp_replace(filled(text), r"(?U)[\s\W_]+", ""))


def html_text(page: Column, most: int = 2000) -> Column:
    """Text without script and style blocks and tags, white space collapsed; `most` characters, the feature's limit."""
    text = F.regexp_replace(filled(page), r"(?i)<(script|style)[\s\S]*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def json_body(text: Column) -> Column:
    """From the first { to the last }, code fences left aside; empty without them."""
    return F.regexp_extract(filled(text), r"(\{[\s\S]*\})", 1)


def analysis_tag(text: Column) -> Column:
    return strip(F.regexp_extract(filled(text), r"<analysis>([\s\S]*?)</analysis>", 1))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def dedupe_key(url: Column, title: Column, snippet: Column) -> Column:
    """The url, or else the beginning of title and snippet in lower case."""
    stripped = F.trim(filled(url))
    return F.when(stripped != "", stripped).otherwise(F.lower(F.substring(F.concat(filled(title), filled(snippet)), 1, 60)))


def safe_name(text: Column, most: int = 31, default: str = "sheet") -> Column:
    """A name of letters, digits, - and _ only."""
    name = F.substring(F.regexp_replace(F.trim(filled(text)), r"[^0-9a-zA-Z_\-]", "_"), 1, most)
    return F.when(name == "", default).otherwise(name)


def prompt(question: Column, context: Column, context_label: str = "Context:", question_label: str = "Question:") -> Column:
    """The stripped question, behind a labelled context where there is one. The reference never is an input."""
    asked, given = strip(question), strip(context)
    return F.when(given == "", asked).otherwise(strip(F.concat(F.lit(context_label + "\n"), given, F.lit("\n\n" + question_label + "\n"), asked)))


def json_string(text: Column) -> Column:
    """The text as a JSON string, in quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)


def display_value(value: Column, kind: str) -> Column:
    """A value in a log line: yes or no for booleans, - for null, JSON for nested ones; else its text, line ends escaped, as a JSON
    string where it holds white space, a bar or an equals sign."""
    if kind == "boolean":
        shown = F.when(value, F.lit("是")).otherwise(F.lit("否"))
    elif kind.startswith(("array", "map", "struct")):
        shown = F.to_json(value)
    else:
        text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
        shown = F.when(text.rlike(r"(?U)[\s|=]"), json_string(text)).otherwise(text)
    return F.when(value.isNull(), F.lit("-")).otherwise(shown)


def details(fields: dict[str, tuple[Column, str]]) -> Column:
    """A log line's details, `name=value | name=value`, from name -> (value, kind); null and empty values are left out."""
    shown = lambda name, value, kind: F.when(value.isNotNull() & (value.cast("string") != "" if kind == "string" else F.lit(True)), F.concat(F.lit(name + "="), display_value(value, kind)))
    return F.concat_ws(" | ", *(shown(name, *field) for name, field in fields.items()))


def retriable(status: Column, message: Column) -> Column:
    """Whether a failed call may be tried again, by HTTP status or by words of its message."""
    return F.coalesce(status.isin(408, 409, 429, 500, 502, 503, 504), F.lit(False)) | F.lower(filled(message)).rlike("time.?out|connection|temporar|overloaded|rate.?limit")
