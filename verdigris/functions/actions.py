"""Actions in a dialogue's turns.  Nested braces are not regular, so these run in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

ACTION = StructType([StructField("action", StringType()), StructField("query", StringType()), StructField("parsed", BooleanType())])
CALL = StructType([StructField("action", StringType()), StructField("query", StringType())])
# The fields that replies use for an action and for what it asks.
NAMES, ASKS = ("action", "action_type"), ("query", "action_text", "content")


def _objects(text: str) -> list[str]:
    """Balanced spans of braces, outermost only, in order; a span that never closes is none."""
    found, level, since = [], 0, 0
    for brace in re.finditer(r"[{}]", text):
        if brace[0] == "{":
            since = since if level else brace.start()
            level += 1
        elif level:
            level -= 1
            if not level:
                found.append(text[since : brace.end()])
    return found


@F.pandas_udf(ArrayType(StringType()))
def json_objects(values: pd.Series) -> pd.Series:
    return values.map(lambda s: _objects(s or ""))


def _told(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _fields(objects: str) -> dict | None:
    try:
        value = json.loads(objects)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(CALL)
def _json_call(bodies: pd.Series, known: pd.Series) -> pd.DataFrame:
    """Of the objects that a body is or holds, the first that names a known action, and what it asks."""

    def first(body: str, names: set[str]) -> tuple[str | None, str | None]:
        for fields in filter(None, map(_fields, [body, *_objects(body)])):
            filled = {k: v for k, v in fields.items() if v}
            name = str(filled[min(filled.keys() & set(NAMES), key=NAMES.index)]).strip().lower() if filled.keys() & set(NAMES) else None
            if name in names:
                return name, next((_told(filled[k]) for k in ASKS if k in filled), "")
        return None, None

    return pd.DataFrame([first(b, set(k)) for b, k in zip(bodies, known, strict=True)], columns=CALL.names)


def parse_action(reply: Column, actions: tuple[str, ...]) -> Column:
    """Struct of action, query, parsed: strict JSON, then JSON within the reply, then an action's name and the rest of its line.

    Only the reading of JSON runs in Arrow batches; fences and names are expressions.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), "^\\s+|\\s+$", ""), "(?m)^```(?:json)?|```\\z", "")
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    call = _json_call(body, F.array(*[F.lit(a) for a in actions]))
    spoken = [F.regexp_extract(F.lower(body), f"\\b({re.escape(a)})\\b\\W{{0,4}}(.*)", 2) for a in actions]
    named = F.lit(None).cast(ACTION)
    for a, rest in list(zip(actions, spoken, strict=True))[::-1]:
        named = F.when(F.rlike(F.lower(body), F.lit(f"\\b{re.escape(a)}\\b")), F.struct(F.lit(a).alias("action"), F.trim(rest).alias("query"), F.lit(True).alias("parsed"))).otherwise(named)
    unread = F.struct(F.lit("").alias("action"), F.when(body != "", body).alias("query"), F.lit(False).alias("parsed"))
    read = F.struct(call["action"].alias("action"), call["query"].alias("query"), F.lit(True).alias("parsed"))
    return F.when(call["action"].isNotNull(), read).when((body != "") & named.isNotNull(), named).otherwise(unread)


def findings(section: Column, least: int = 12) -> Column:
    """(key, text) of a case section's sentences: parts between sentence or line ends, short ones left out but counted."""
    parts = F.transform(F.split(F.coalesce(section, F.lit("")), "(?<=[.;])\\s+|\\n+"), lambda x, i: F.struct(i.cast("string").alias("key"), F.regexp_replace(x, "^[ \\t-]+|[ \\t-]+$", "").alias("text")))
    return F.filter(parts, lambda s: F.length(s["text"]) >= least)


# The headings of a topology.
HEADINGS = ("Entities in the incident window:", "Call/dependency edges:")


def topology_text(entities: Column, edges: Column, most_entities: int = 40, most_edges: int = 60) -> Column:
    """Entities (name, type) and edges (source, target) as two lists of lines; an empty list has no heading."""
    some = lambda c: F.coalesce(F.trim(c), F.lit(""))
    names = F.transform(F.filter(F.slice(entities, 1, most_entities), lambda e: some(e["name"]) != ""), lambda e: F.concat(F.lit("- "), F.trim(e["name"]), F.when(some(e["type"]) != "", F.concat(F.lit(" ("), F.trim(e["type"]), F.lit(")"))).otherwise("")))
    calls = F.transform(F.filter(F.slice(edges, 1, most_edges), lambda e: (some(e["source"]) != "") & (some(e["target"]) != "")), lambda e: F.concat(F.lit("- "), F.trim(e["source"]), F.lit(" -> "), F.trim(e["target"])))
    block = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head + "\n"), F.array_join(x, "\n")))
    return F.concat_ws("\n\n", block(HEADINGS[0], names), block(HEADINGS[1], calls))


def context_text(docs: Column, most: int = 5, chars: int = 400) -> Column:
    """The first documents' snippets, numbered."""
    return F.array_join(F.transform(F.slice(docs, 1, most), lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(F.trim(d), F.lit(chars)))), "\n")


def evidence_line(token: Column, questions: Column, meanings: Column) -> Column:
    """A coded finding `code_@_value`, or `code` alone, as a line; null for an unknown code."""
    parts = F.split(token, "_@_")
    question, value = F.try_element_at(questions, F.element_at(parts, 1)), F.try_element_at(parts, F.lit(2))
    return F.when(value.isNull(), F.concat(question, F.lit(" yes"))).otherwise(F.concat(question, F.lit(" "), F.coalesce(F.try_element_at(meanings, value), value)))
