"""Reading answers out of replies, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import EMPTY_SELECTION, once

# Words of a direct answer, and the tags of the reply format.
YES, NO = ("yes", "true", "correct", "affirmative"), ("no", "false", "incorrect", "negative")
AFFIRMED = ("yes", "true", "correct", "match", "1")
# What bodies of failed calls say of a text that is too long, and of a tunnel that is down.
TOO_LONG = ("maximum context length", "context_length_exceeded", "longer than the maximum", "reduce the length", "please reduce", "max_model_len", "token limit")
NO_TUNNEL = (
    "error code: 1033", "error code: 502", "error code: 504", "argo tunnel", "cloudflared", "tunnel error", "bad gateway", "gateway time-out", "gateway timeout", "no tunnel", "web server is down",
)
# Statuses that pass by themselves.
PASSING = (408, 409, 425, 500, 502, 503, 504, 520, 521, 522, 523, 524, 530)
# How a label is written at the head of an answer, after a word for choosing, and by itself.
LABEL_HEAD, LABEL_SAID, LABEL_ALONE = "(?i)^\\(?\\[?({})\\)?\\]?\\s*[).:,-]?\\s*", "(?i)(?:answer|choice|option|label|select(?:ed)?)\\D{{0,20}}?\\b({})\\b", "(?<![A-Za-z0-9])\\(?({})\\)?(?![A-Za-z0-9])"
TAGS = "(?i)</?\\s*(?:think|answer|reasoning_chain|reasoning_trace)\\s*>"
NUMBER = "-?\\d[\\d,]*\\.?\\d*(?:[eE][-+]?\\d+)?"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def after_last(x: Column, marker: str) -> Column:
    """What follows the marker's last occurrence, case aside; the text itself without one."""

    def rest(x: Column) -> Column:
        at = F.length(x) - F.locate(marker.lower()[::-1], F.reverse(F.lower(x))) + 2
        return F.when(F.contains(F.lower(x), F.lit(marker.lower())), _strip(F.regexp_replace(_strip(F.substr(x, at)), "^:+", ""))).otherwise(x)

    return once(x, rest)


def strip_markdown(x: Column) -> Column:
    body = _strip(F.regexp_replace(_strip(x), "^`+|`+$", ""))
    return _strip(F.regexp_replace(body, "^\\*+|\\*+$", ""))


def answer_span(text: Column, regex: str | None = None, group: int = 1, prefix: str | None = None, markdown: bool = True) -> Column:
    """The answer: the pattern's group if it matches, then what follows the prefix's last occurrence, without markdown.

    A null text gives an empty span; without a match the whole text is the span.
    """
    body = _strip(F.coalesce(text, F.lit("")))
    if regex:
        body = F.when(F.rlike(body, F.lit(f"(?is){regex}")), _strip(F.regexp_extract(body, f"(?is){regex}", group))).otherwise(body)
    if prefix:
        body = after_last(body, prefix)
    return strip_markdown(body) if markdown else body


def _alternatives(labels: tuple[str, ...]) -> str:
    return "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))


def canonical_label(x: Column, labels: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter(F.array(*[F.lit(v) for v in labels]), lambda v: F.lower(v) == F.lower(x)), F.lit(1))


def choice_label(text: Column, labels: tuple[str, ...], prefix: str | None = None) -> Column:
    """The single label chosen: at the head of the span or text, else the last 'answer is X', else the last that stands alone; null if none."""
    any_of = _alternatives(labels)
    head = LABEL_HEAD.format(any_of)
    span = answer_span(text, prefix=prefix)
    at_head = [F.nullif(F.regexp_extract(_strip(x), head, 1), F.lit("")) for x in (span, text)]
    said = F.regexp_extract_all(text, F.lit(LABEL_SAID.format(any_of)), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(LABEL_ALONE.format(any_of)), F.lit(1))
    return canonical_label(F.coalesce(*at_head, F.try_element_at(said, F.lit(-1)), F.try_element_at(alone, F.lit(-1))), labels)


def choice_labels(text: Column, labels: tuple[str, ...], prefix: str | None = None) -> Column:
    """All labels of the answer line in order; an empty list for an explicit none, null if nothing can be read.

    Where nothing follows the prefix, the last line that is not blank is read.
    """
    last = F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), "\\r\\n|[\\n\\r]"), lambda x: _strip(x) != ""), F.lit(-1))

    def named(span: Column) -> Column:
        found = F.regexp_extract_all(span, F.lit("(?i)" + LABEL_ALONE.format(_alternatives(labels))), F.lit(1))
        bare = F.lower(_strip(F.regexp_replace(span, "[^\\w\\s/-]", " ")))
        none = F.when(bare.isin(*EMPTY_SELECTION), F.array().cast("array<string>"))
        return once(F.array_distinct(F.transform(found, lambda x: canonical_label(x, labels))), lambda out: F.when(F.size(out) > 0, out).otherwise(none))

    span = once(answer_span(text, prefix=prefix), lambda s: F.when(s == "", _strip(F.coalesce(last, F.lit("")))).otherwise(s))
    return once(span, named)


def first_number(text: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def _first_word(text: Column) -> Column:
    whole = _strip(F.coalesce(text, F.lit("")))
    span = answer_span(text, prefix="Answer:")
    span = F.when(span == "", F.right(whole, F.lit(120))).otherwise(span)
    bare = F.lower(F.regexp_replace(_strip(span), "^[*_`\"' .]+|[*_`\"' .]+$", ""))
    return F.regexp_replace(F.try_element_at(F.split(bare, "\\s+"), F.lit(1)), "^[.,;:!]+|[.,;:!]+$", "")


def said_yes(text: Column) -> Column:
    """Is the answer a direct yes; a hedge, or nothing, is not."""
    return F.coalesce(_first_word(text).isin(*YES), F.lit(False))


def parsed_yes_or_no(text: Column) -> Column:
    return F.coalesce(_first_word(text).isin(*YES, *NO), F.lit(False))


def _meaning(x: Column) -> Column:
    """The text, or nothing if it holds no word at all."""
    body = _strip(F.coalesce(x, F.lit("")))
    return F.when(F.rlike(body, F.lit("\\w")), body).otherwise(F.lit(""))


def clean_trace(x: Column) -> Column:
    """The trace without answer blocks and tags; a placeholder counts as empty."""
    return _meaning(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "(?s)<answer>.*?</answer>", ""), TAGS, ""))


def reasoning_trace(content: Column, reasoning: Column) -> Column:
    """Struct of text and source: the visible block, else the native field, else untagged prose, else none."""
    content = F.coalesce(content, F.lit(""))
    block = "(?s)<think>\\s*(.*?)\\s*(?:</think>|\\z)"  # a block that was cut off counts as well
    tagged = F.rlike(content, F.lit(block))
    visible = F.when(tagged, clean_trace(F.regexp_extract(content, block, 1))).otherwise("")
    prose = F.when(~tagged, clean_trace(content)).otherwise("")
    said = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    # each text is worked out once, and the first that says something is taken
    found = F.array(said(visible, "visible_cot"), said(clean_trace(reasoning), "native_reasoning"), said(prose, "untagged_prose"))
    return F.coalesce(F.get(F.filter(found, lambda f: f["text"] != ""), F.lit(0)), said(F.lit(""), "none"))


def missing_answer(content: Column, finish_reason: Column) -> Column:
    """Why a reply gave no answer: empty_reply, or cut_off_before_answering; null if it did."""
    body = _strip(F.coalesce(content, F.lit("")))
    cut = (F.coalesce(finish_reason, F.lit("")) == "length") & ~F.contains(F.lower(body), F.lit("</answer>"))
    return F.when(body == "", F.lit("empty_reply")).when(cut, F.lit("cut_off_before_answering"))


def format_compliance(text: Column, reasoning: Column, cot: Column) -> Column:
    """Exactly one answer block, under cot one think block before it, and nothing else; native reasoning stands for the think block."""
    body = _strip(F.coalesce(text, F.lit("")))
    opens = F.contains(body, F.lit("<think>"))
    native = cot & ~opens & (_meaning(reasoning) != "")
    one = F.regexp_count(body, F.lit("<answer>")) == 1
    plain = F.rlike(body, F.lit("(?s)\\A<answer>.*?</answer>\\z")) & one & ~opens
    both = F.rlike(body, F.lit("(?s)\\A<think>.*?</think>\\s*<answer>.*?</answer>\\z")) & one & (F.regexp_count(body, F.lit("<think>")) == 1)
    return F.when(cot & ~native, both).otherwise(plain)


def verdict(text: Column, top: float = 1.0) -> Column:
    """Struct of label and score of a judge's reply: 'Label: x', 'Score: n' scaled to 0..1; a malformed or outlying score voids both."""
    label = F.lower(F.nullif(F.regexp_extract(text, "(?i)(?:verdict|label)\\s*[:=]\\s*\\**\\s*([A-Za-z_]+)", 1), F.lit("")))
    said = F.rlike(text, F.lit("(?i)score\\s*[:=]"))
    raw = F.nullif(F.regexp_extract(text, "(?i)score\\s*[:=]\\s*\\**\\s*(-?\\d+(?:\\.\\d+)?)(?![\\d])(?!\\.\\d)", 1), F.lit("")).try_cast("double")
    good = raw.between(0, top)
    void = said & ~F.coalesce(good, F.lit(False))
    return F.struct(F.when(~void, label).alias("label"), F.when(good, raw / top).alias("score"))


def positive(label: Column, score: Column) -> Column:
    return F.when(score.isNotNull(), score >= 0.5).otherwise(F.coalesce(F.lower(_strip(label)).isin(*AFFIRMED), F.lit(False)))


def turn_prediction(text: Column, most: int = 200) -> Column:
    """The last answer block, else the last line that is not blank."""
    blocks = F.regexp_extract_all(text, F.lit("(?is)<answer>(.*?)</answer>"), F.lit(1))
    lines = F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != "")
    return F.nullif(F.left(_strip(F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.try_element_at(lines, F.lit(-1)))), F.lit(most)), F.lit(""))


def option_list(raw: Column) -> Column:
    """(label, text) of options written like '(a) text (b) text'."""
    labels = F.regexp_extract_all(raw, F.lit("\\(([a-z])\\)\\s*([^()]+)"), F.lit(1))
    texts = F.regexp_extract_all(raw, F.lit("\\(([a-z])\\)\\s*([^()]+)"), F.lit(2))
    return F.arrays_zip(labels.alias("label"), F.transform(texts, lambda x: F.trim(x)).alias("text"))


def premise_ids(proof: Column) -> Column:
    """Ids of the sentences left of the arrow."""
    return F.transform(F.regexp_extract_all(F.element_at(F.split(proof, "->"), 1), F.lit("\\bsent(\\d+)\\b"), F.lit(1)), lambda x: x.cast("int"))


def clean_expression(x: Column) -> Column:
    """First line that is not blank; 'L = 0' gives L, 'L = R' gives '(L) - (R)', '^' becomes '**'."""
    line = F.trim(F.coalesce(F.try_element_at(F.filter(F.split(x, "\\n"), lambda v: F.trim(v) != ""), F.lit(1)), F.lit("")))
    sides = F.transform(F.split(line, "=", 2), lambda v: F.trim(v))
    left, right = F.element_at(sides, 1), F.try_element_at(sides, F.lit(2))
    return F.replace(F.when(right.isNull() | (right == "0"), left).otherwise(F.concat(F.lit("("), left, F.lit(") - ("), right, F.lit(")"))), F.lit("^"), F.lit("**"))


def known_keys(raw: Column, known: Column) -> Column:
    """Known keys that a reply names: quoted ones in order, else those that stand as words, longest first."""
    quoted = F.filter(F.array_distinct(F.regexp_extract_all(raw, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))), lambda k: F.array_contains(known, k))
    named = F.filter(known, lambda k: F.rlike(raw, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])\\Q"), k, F.lit("\\E(?![A-Za-z0-9_])"))))
    by_length = F.transform(F.array_sort(F.transform(named, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])
    return F.when(F.size(quoted) > 0, quoted).otherwise(by_length)


def error_class(status: Column, body: Column) -> Column:
    """What the HTTP status and body of a call mean for a retry; a status below 400 is ok.

    The body decides only where the status doesn't: one that tells of a text
    that is too long makes any other failure a context failure.
    """
    low = F.lower(F.coalesce(body, F.lit("")))
    tells = lambda marks: F.rlike(low, F.lit("|".join(map(re.escape, marks))))
    by_body = F.when(tells(TOO_LONG), "context_length").when(status.isin(400, 422), "invalid_request").when(status.isin(*PASSING) | tells(NO_TUNNEL), "transient").otherwise("unknown")
    by_status = F.when(status < 400, "ok").when(status == 429, "rate_limit").when(status.isin(401, 403), "auth").when(status == 404, "invalid_request")
    return by_status.otherwise(by_body)
