"""Fields as datasets ship them: literals in text, names, formulas, identities of requests, turns of an episode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType

from verdigris.functions import extract, stats, text

# Words that name no actor by themselves.
ACTOR_FILLER = ("the", "group", "apt", "team", "actor", "threat", "cluster")


def actor_name(x: Column) -> Column:
    """Letters and digits in lower case without filler words, unless nothing else is there."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(*ACTOR_FILLER))
    return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(words), " ")


def canonical_formula(x: Column) -> Column:
    """Lower case, blanks collapsed, none beside a parenthesis."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "\\s+", " "), "\\s*([()])\\s*", "$1")


def formula_span(x: Column) -> Column:
    """The first balanced parenthesis of an answer; all that follows an open one, or the whole answer without any."""
    body = F.regexp_replace(F.trim(x), "^`+|`+$", "")
    rest = F.substr(body, F.locate("(", body))
    letters = F.split(rest, "")
    step = lambda a, c: F.when(a["end"] > 0, a).otherwise(_depth(a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0), a["at"] + 1))
    end = F.aggregate(letters, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step)["end"]
    return F.when(F.locate("(", body) == 0, body).when(end > 0, F.substr(rest, F.lit(1), end)).otherwise(rest)


def _depth(depth: Column, at: Column) -> Column:
    return F.struct(depth.alias("depth"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end"))


def differential(raw: Column) -> Column:
    """(name, probability) of a list literal, the most probable first, equals in their order; a malformed cell is empty."""
    entries = F.coalesce(F.from_json(F.coalesce(raw, F.lit("")), "array<array<string>>"), F.array().cast("array<array<string>>"))
    pairs = F.transform(F.filter(entries, lambda e: F.size(e) > 0), lambda e, i: F.struct((-F.coalesce(F.try_element_at(e, F.lit(2)).try_cast("double"), F.lit(0.0))).alias("p"), i.alias("i"), e[0].alias("name")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["name"].alias("name"), (-s["p"]).alias("probability")))


def listish(x: Column) -> Column:
    """The strings of a list literal; any other text is a list of itself, and nothing is an empty list."""
    body = F.trim(F.coalesce(x, F.lit("")))
    parsed = F.from_json(F.when(F.startswith(body, F.lit("[")), body), "array<string>")
    return F.when(body.isin("", "[]", "nan"), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(body)))


def first_reading(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def context_position(chunk: Column) -> Column:
    """Chunks before the one with the answer; null if that is no whole number."""
    return chunk.try_cast("int") - 1


def first_present(*candidates: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def round_report(x: Column, digits: int = 4) -> Column:
    """Half to even of the binary value, as reports print: 9.05 is a little more than a tie, 2.675 a little less.

    Rounding by the shortest decimal is right unless that is a tie; then 78 bits
    of the fraction are compared with the tie as whole numbers.
    """
    scale, limb = 10**digits, 2**26
    wide = lambda c, k=20: c.cast(f"decimal({k},0)")

    def of(v: Column) -> Column:
        m = F.abs(v)
        told = m.try_cast("decimal(33,17)") * F.lit(scale).cast("decimal(5,0)")
        is_tie = (m < 2**31) & (told - F.floor(told) == F.lit(0.5).cast("decimal(2,1)"))
        return F.when(is_tie, _with(F.struct(m.alias("m"), F.floor(told).cast("bigint").alias("base"), (v < 0).alias("minus")), lambda s: settled(s, v))).otherwise(F.bround(v, digits))

    def settled(s: Column, v: Column) -> Column:
        whole = F.floor(s["m"])
        one = (s["m"] - whole) * limb
        two = (one - F.floor(one)) * limb
        three = (two - F.floor(two)) * limb
        bits = wide(wide(F.floor(one) * limb + F.floor(two), 16) * F.lit(limb).cast("decimal(8,0)") + wide(F.floor(three), 8), 25) * F.lit(2 * scale).cast("decimal(6,0)")
        tie = wide(2 * (s["base"] - whole * scale) + 1, 6) * F.lit(str(limb**3)).cast("decimal(24,0)")
        near = F.when(bits > tie, (s["base"] + 1) / scale).when(bits < tie, s["base"] / scale)
        return F.coalesce(F.when(s["minus"], -near).otherwise(near), F.bround(v, digits))

    return _with(x.cast("double"), of)


def conversation_tokens(messages: Column, overhead: int = 4, margin: int = 0) -> Column:
    """Estimated tokens of (role, content) messages: content, role and an overhead each, and a margin."""
    each = lambda m: stats.token_estimate(m["content"]) + stats.token_estimate(m["role"]) + overhead
    return F.aggregate(messages, F.lit(margin).cast("bigint"), lambda a, m: a + each(m))


def sorted_json(x: Column, kind: DataType) -> Column:
    """JSON with sorted keys, and a blank after commas and colons."""
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f'"{f.name}": '), sorted_json(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: sorted_json(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(sorted_json(e["key"], StringType()), F.lit(": "), sorted_json(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x)), pair), ", "), F.lit("}"))
    elif isinstance(kind, StringType):
        quoted = F.to_json(F.array(x))
        out = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    else:
        out = F.lower(x.cast("string")) if isinstance(kind, BooleanType) else x.cast("string")
    return F.coalesce(out, F.lit("null"))


def payload_hash(x: Column, kind: DataType, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the sorted JSON."""
    return F.left(F.sha2(sorted_json(x, kind), 256), F.lit(length))


def merged_sampling(base: Column, override: Column) -> Column:
    """Two maps as one: what the override gives, and isn't null, wins."""
    kept = F.map_filter(override, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def matches_final(predictions: Column) -> Column:
    """1 for each turn whose prediction names the same actor as the last one, else null."""
    final = actor_name(F.try_element_at(predictions, F.lit(-1)))
    return F.transform(predictions, lambda p: F.when((final != "") & (actor_name(p) == final), 1))


def provisional(said: Column, accepted: Column) -> Column:
    """Struct of given and match: was a provisional answer given, and does it contain an accepted one."""
    body = F.trim(F.coalesce(said, F.lit("")))
    hit = F.exists(accepted, lambda a: text.contains_match(body, a) == 1)
    return F.struct((body != "").cast("double").alias("given"), F.when(body != "", hit.cast("double")).alias("match"))


def forced_answer(submitted: Column, prediction: Column, last_action: Column) -> Column:
    """What is judged: a submitted prediction, else the last action's content, if it has any."""
    return F.when(submitted, prediction).otherwise(F.coalesce(F.nullif(F.trim(last_action), F.lit("")), prediction))


def failed_families(errors: Column) -> Column:
    """Families, in order, of the errors that say a judge failed."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(errors, lambda e: F.contains(e, F.lit(":judge_failed"))), lambda e: F.substring_index(e, ":", 1))))


def misplaced(content: Column, reasoning: Column) -> Column:
    """A reply whose content is blank while its reasoning is not."""
    return (F.trim(F.coalesce(content, F.lit(""))) == "") & (F.trim(F.coalesce(reasoning, F.lit(""))) != "")


def repaired_channels(reasoning: Column, finish_reason: Column) -> Column:
    """Struct of content, reasoning, status and how, of a reply that stands whole in its reasoning.

    Content begins at the first think tag, else at the last answer tag; without
    either nothing is repaired.
    """
    think, answer = F.locate("<think>", reasoning), F.length(reasoning) - F.locate(">rewsna<", F.reverse(reasoning)) - 6
    answer = F.when(F.contains(reasoning, F.lit("<answer>")), answer).otherwise(0)
    at, how = F.when(think > 0, think).otherwise(answer), F.when(think > 0, "think").when(answer > 0, "answer").otherwise("none")
    before = F.nullif(F.trim(F.left(reasoning, at - 1)), F.lit(""))
    status = F.when(finish_reason == "length", "truncated").otherwise("ok")
    return F.struct(
        F.when(at > 0, F.substr(reasoning, at)).otherwise("").alias("content"), F.when(at > 0, before).otherwise(reasoning).alias("reasoning"), F.when(at > 0, status).alias("status"), how.alias("how"),
    )


def tagged_answer(x: Column) -> Column:
    return F.concat(F.lit("<answer>"), x, F.lit("</answer>"))


def parent_findings(keys: Column, separator: str = ".") -> Column:
    """(parent, leaves) of dotted keys, parents in order of their names, leaves as they come."""
    leaf = lambda k: F.substring_index(k, separator, -1)
    parent = lambda k: F.when(F.contains(k, F.lit(separator)), F.left(k, F.length(k) - F.length(leaf(k)) - len(separator))).otherwise(k)
    names = F.array_sort(F.array_distinct(F.transform(keys, parent)))
    return F.transform(names, lambda p: F.struct(p.alias("parent"), F.transform(F.filter(keys, lambda k: parent(k) == p), leaf).alias("leaves")))


def repaired_reply(content: Column, reasoning: Column, finish_reason: Column) -> Column:
    """Why the repaired reply still gives no answer, or null."""
    fixed = repaired_channels(reasoning, finish_reason)
    return F.when(misplaced(content, reasoning), extract.missing_answer(fixed["content"], finish_reason)).otherwise(extract.missing_answer(content, finish_reason))
