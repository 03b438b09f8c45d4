"""Column expressions over text: tokens, stripping, hashed bags of tokens."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from spanforge.functions import splitters

#: What a lexical token and an answer token are.
LEXICAL, ANSWER = r"[A-Za-z0-9][A-Za-z0-9_\-.]*", r"[a-z0-9]+"
#: Phrases by which an answer is taken as a refusal.
REFUSALS = (
    "i don't know", "i do not know", "not in the", "no information", "cannot answer", "can't answer",
    "not provided", "does not contain", "doesn't contain", "unable to answer", "insufficient",
)
#: Dimensions of the hashed bag, the stand-in for an embedding model.
DIMS = 64


def lexical_tokens(text: Column) -> Column:
    """Tokens of the inverted index: matched first, lower-cased after."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEXICAL), F.lit(0)), F.lower)


def answer_tokens(text: Column) -> Column:
    """Tokens of answer scoring: lower-cased first."""
    return F.regexp_extract_all(F.lower(text), F.lit(ANSWER), F.lit(0))


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_content(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def with_context(text: Column, prefix: Column) -> Column:
    """What is indexed: the heading path, if any, an empty line, and the chunk."""
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_bag(texts: pd.Series) -> pd.Series:
    """Unit vector of token counts by hashed dimension, zeros without tokens: the embedder where there is no model.

    A model takes its place as another vectorised function from texts to arrays, loaded once a worker.
    """
    return pd.Series(list(splitters.bag_vectors([t or "" for t in texts], DIMS)))


def is_refusal(answer: Column) -> Column:
    low = F.lower(strip(answer))
    found = low == ""
    for phrase in REFUSALS:
        found = found | low.contains(phrase)
    return found


def first_value(document: object, key: str, levels: int = 4) -> object | None:
    """The first value under ``key``, not null, in nested dicts and lists, the outer before the inner, ``levels`` of them deep.

    A dict that has the key is not searched further.
    """
    todo = [(document, levels)]
    while todo:
        node, left = todo.pop()
        inside = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        if isinstance(node, dict) and key in node:
            if node[key] is not None:
                return node[key]
        elif left > 1:
            todo += [(child, left - 1) for child in reversed(inside)]
    return None


def score_of(payload: str | None, key: str = "score") -> float | None:
    """Score in [0, 1] out of a judge's JSON, else null: what stands around the outermost braces is left out if it has to be."""
    for text in (payload or "", (payload or "")[(payload or "").find("{") :][: (payload or "").rfind("}") - (payload or "").find("{") + 1]):
        try:
            found = first_value(json.loads(text), key)
            break
        except ValueError:
            found = None
    try:
        value = float(found.strip().rstrip("%") if isinstance(found, str) else found)
    except (TypeError, ValueError, OverflowError):
        return None
    if math.isnan(value):
        return None
    return max(0.0, min(1.0, value / 100 if value >= 10 else value))


@F.pandas_udf(DoubleType())
def judged_score(payload: pd.Series) -> pd.Series:
    """Score in [0, 1] of each judge's reply, else null.

    Booleans are 1 and 0, a per cent sign goes, 10 and more are per cent, the rest is clamped. A search of any nesting cannot be
    written as paths, so replies are parsed in batches.
    """
    return pd.Series([score_of(p) for p in payload], dtype=object)
