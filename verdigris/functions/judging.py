"""What a judge replied, as the object that its template's contract asks for."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from verdigris.functions import validators
from verdigris.functions.actions import _fields, _objects

# The contracts of a field.
LISTS = {
    "list_of_nonnegative_integers": validators.int_list, "list_of_binary": validators.binary_list, "list_of_binary_values": validators.binary_list,
    "list_of_directionality_values": validators.directionality_list, "list_of_ternary": validators.ternary_list,
}
NUMBERS = {"nonnegative_integer": validators.nonnegative_int, "nonnegative_integer_or_null": validators.nonnegative_int, "binary": validators.binary, "directionality": lambda v: F.when(v.isin(0.0, 0.5, 1.0), v)}
#: Types of numbers in a variant's schema.
NUMBER = "(BIGINT|DOUBLE|FLOAT|DECIMAL\\(.*\\))"


@F.pandas_udf(ArrayType(StringType()))
def reply_objects(replies: pd.Series) -> pd.Series:
    """The JSON objects of a reply in the order in which they are tried: the whole, then those inside it from the last on.

    Braces in prose can hide an object from the balanced spans, so flat spans
    follow.  Each is written anew, as JSON that other readers take.
    """

    def tried(reply: str) -> list[str]:
        body = reply.strip()
        if body.startswith("```"):
            body = re.sub(r"(?i)\A```(json)?\s*|\s*```\Z", "", body)
        spans = [body, *reversed(_objects(body)), *reversed(re.findall(r"\{[^{}]*\}", body))]
        return [json.dumps(found, ensure_ascii=False) for found in map(_fields, spans) if found is not None]

    return replies.fillna("").map(tried)


def keeps(value: Column, contract: str) -> Column:
    """Does a field's value, a variant, keep the contract; one that is not known is kept."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    get = lambda as_type: F.try_variant_get(value, "$", as_type)
    if contract == "list_of_strings":
        good = (kind == "ARRAY<STRING>") & validators.string_list(get("array<string>")).isNotNull()
    elif contract in LISTS:
        good = F.rlike(kind, F.lit(f"^ARRAY<({NUMBER}|VOID)>$")) & LISTS[contract](get("array<double>")).isNotNull()
    elif contract in NUMBERS:
        good = F.rlike(kind, F.lit(f"^{NUMBER}$")) & NUMBERS[contract](get("double")).isNotNull()
    elif contract == "string_or_null":
        good = kind == "STRING"
    else:
        return F.lit(True)
    good = F.coalesce(good, F.lit(False))
    return good | (kind == "VOID") if contract.endswith("_or_null") else good


def verdict_object(reply: Column, fields: Mapping[str, str]) -> Column:
    """The JSON text of the first object that has every field, each as its contract says; null without one.

    fields: name -> contract, one of LISTS, of NUMBERS, list_of_strings or string_or_null.
    """

    def usable(o: Column) -> Column:
        names, whole = F.json_object_keys(o), F.try_parse_json(o)
        out = F.lit(True)
        for name, contract in fields.items():
            out = out & F.array_contains(names, name) & keeps(F.try_variant_get(whole, f"$['{name}']", "variant"), contract)
        return out

    return F.try_element_at(F.filter(reply_objects(reply), usable), F.lit(1))
