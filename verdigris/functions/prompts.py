"""Prompts as columns: what a dataset says of its task, and the scaffolding that a mode adds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.functions.templates import TemplateError, compiled

# The wording that models are sent; request identities depend on it.
DIRECT = "Answer directly. Do not explain your reasoning."
STEPS = (
    "Reason and explain explicitly by working through the evidence step by step before answering. "
    "Consider what {} would have to be true for, and whether it accounts for everything observed rather than only part of it."
)
MANY, ONE = "each candidate explanation", "this hypothesis"
ANSWER_ONLY = "Reply with exactly one answer block and nothing else:\n<answer>your answer</answer>\nWrite nothing before it and nothing after it. Do not include a <think> block."
THINK_FIRST = (
    "Put all of your reasoning inside one think block, then give your answer inside one answer block:\n<think>your reasoning</think>\n<answer>your answer</answer>\n"
    "Write nothing before the think block and nothing after the answer block, and put the answer only inside the answer block -- not inside the think block as well."
)
YES_OR_NO = (
    "You are shown one candidate hypothesis at a time; the others are not listed here, so judge this one on its own merits rather than against them.\n"
    "Decide whether this hypothesis {}.\nAnswer with only YES or NO."
)
SEVERAL = "Select every hypothesis that applies -- there may be one or several.\nAnswer with only their {}, separated by commas."
EXACTLY_ONE = "Select exactly one hypothesis.\nAnswer with only one of: {}."
REASONING_MODES = ("cot", "self-consistency")

MESSAGE = "array<struct<role:string,content:string>>"
BLANKS = "^\\s+|\\s+$"


def _filled(wording: str, *values: Column) -> Column:
    """The wording with its braces filled by columns."""
    pieces = wording.split("{}")
    return F.concat(F.lit(pieces[0]), *[x for v, p in zip(values, pieces[1:], strict=True) for x in (v, F.lit(p))])


def _headed(head: str | Column, body: Column) -> Column:
    """The body under its head; null if it says nothing."""
    return F.when(body != "", F.concat(F.lit(head) if isinstance(head, str) else head, body))


def _lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def _blocks(*parts: Column) -> Column:
    """What says something, parted by empty lines."""
    return F.regexp_replace(F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts]), BLANKS, "")


def _messages(system: Column, user: Column) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    both = F.array(F.when(system != "", message("system", system)), message("user", user))
    return F.array_compact(both).cast(MESSAGE)


def requirements(clauses: Column) -> Column:
    """A list of demands under its heading; null without any."""
    return F.when(F.size(clauses) > 0, F.concat(F.lit("Requirements:\n"), _lines(F.transform(clauses, lambda c: F.concat(F.lit("- "), c)))))


def mode_line(prompt_mode: Column, one_at_a_time: Column | None = None) -> Column:
    """The only line of a prompt that says whether to reason."""
    one = F.lit(False) if one_at_a_time is None else one_at_a_time
    return F.when(~prompt_mode.isin(*REASONING_MODES), DIRECT).when(one, STEPS.format(ONE)).otherwise(STEPS.format(MANY))


def label_choice(labels: Column) -> Column:
    """The labels as a sentence names them: `1, 2 or 3`."""
    n = F.size(labels)
    return F.when(n == 0, "the label").when(n == 1, F.try_element_at(labels, F.lit(1))).otherwise(F.concat_ws(" or ", F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), ", "), F.try_element_at(labels, F.lit(-1))))


def labels_of(labels: Column, options: Column) -> Column:
    """The labels that are given, else numbers."""
    return F.when(F.size(labels) > 0, labels).otherwise(text.number_labels(F.greatest(F.coalesce(F.size(options), F.lit(0)), F.lit(0))))


def answer_style(selection: Column, options: Column) -> Column:
    """How the reply is to be read: binary, multi_label, single_label or free_form."""
    asked = F.when(F.size(options) > 0, selection)
    return F.when(asked == "BOV", "binary").when(asked == "MCS", "multi_label").when(asked == "SCS", "single_label").otherwise("free_form")


def _part(parts: Mapping[str, Column], name: str, kind: str = "string") -> Column:
    return parts.get(name, F.lit(None)).cast(kind)


def closing(parts: Mapping[str, Column], selection: Column) -> Column:
    """The answer instruction of a selection mode; without options, of a free answer."""
    options, question = _part(parts, "options", "array<string>"), _part(parts, "question")
    labels = labels_of(_part(parts, "labels", "array<string>"), options)
    noun = F.when((F.size(labels) > 0) & F.forall(labels, lambda x: F.rlike(x, F.lit("^\\p{L}"))), "letters").otherwise("numbers")
    shape = F.coalesce(F.nullif(_part(parts, "answer_format"), F.lit("")), F.lit("your answer"))
    free = F.concat(F.lit("Give "), shape, F.when(_part(parts, "answer_is_block", "boolean"), ", one item per line.").otherwise("."))
    asks = F.when(question != "", "answers that question").otherwise("explains the observation")
    style = answer_style(selection, options)
    return F.when(style == "binary", _filled(YES_OR_NO, asks)).when(style == "multi_label", _filled(SEVERAL, noun)).when(style == "single_label", _filled(EXACTLY_ONE, label_choice(labels))).otherwise(free)


def _evidence(parts: Mapping[str, Column]) -> tuple[Column, Column]:
    return _headed("Background:\n", _part(parts, "context")), _headed("Observation:\n", _part(parts, "observation"))


def static_messages(parts: Mapping[str, Column], prompt_mode: Column, selection: Column) -> Column:
    """The messages of one request.

    parts, each optional: system, context, observation, question, instructions,
    answer_format, options_heading (strings), requirements, options, labels
    (lists), answer_is_block.  What is null or empty is left out.  The mode
    decides the scaffolding alone, so that two rows of one sample differ in it
    and nowhere else; self-consistency is asked as cot is.
    """
    options = _part(parts, "options", "array<string>")
    some = F.coalesce(F.size(options) > 0, F.lit(False))
    one = some & F.coalesce(selection == "BOV", F.lit(False))
    labels = labels_of(_part(parts, "labels", "array<string>"), options)
    heading = F.coalesce(F.nullif(_part(parts, "options_heading"), F.lit("")), F.lit("Candidate hypotheses:"))
    listed = F.concat(heading, F.lit("\n"), _lines(F.zip_with(labels, options, lambda a, b: F.concat(a, F.lit(". "), b))))
    shown = F.when(one, F.concat(F.lit("Hypothesis under consideration:\n"), F.try_element_at(options, F.lit(1)))).when(some, listed)
    asked = _headed(F.when(one, "The question being asked of the candidates:\n").otherwise("Question: "), _part(parts, "question"))
    task = _headed("Task: ", _part(parts, "instructions"))
    user = _blocks(*_evidence(parts), asked, task, requirements(_part(parts, "requirements", "array<string>")), shown, closing(parts, selection))
    shape = F.when(prompt_mode.isin(*REASONING_MODES), THINK_FIRST).otherwise(ANSWER_ONLY)
    system = F.concat_ws("\n\n", F.nullif(F.regexp_replace(_part(parts, "system"), BLANKS, ""), F.lit("")), mode_line(prompt_mode, one), shape)
    return _messages(system, user)


def protocol_messages(parts: Mapping[str, Column], prompt_mode: Column) -> Column:
    """The opening of an interactive benchmark: system, context, observation, instructions, requirements, actions (name, what), output_format."""
    actions = _part(parts, "actions", "array<struct<name:string,what:string>>")
    listed = F.when(F.size(actions) > 0, F.concat(F.lit("Available actions:\n"), _lines(F.transform(actions, lambda a: F.concat(F.lit("- "), a["name"], F.lit(": "), a["what"])))))
    task = _headed("Task: ", _part(parts, "instructions"))
    user = _blocks(*_evidence(parts), task, requirements(_part(parts, "requirements", "array<string>")), listed, mode_line(prompt_mode), _part(parts, "output_format"))
    return _messages(F.coalesce(F.regexp_replace(_part(parts, "system"), BLANKS, ""), F.lit("")), user)


def rendered(template: list[Mapping[str, str]], fields: Mapping[str, Column], required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> Column:
    """The messages of a template with places, conditions and loops (see templates.py), which become one expression.

    A name that is neither a field nor optional is an error when the plan is
    made, wherever it stands, and so is a block that is not closed.  A message
    that renders to nothing is left out; a null field renders as nothing.
    """
    missing = [r for r in required if r not in fields]
    known = {name: F.lit("") for name in optional} | dict(fields)
    messages = [F.struct(F.lit(m["role"]).alias("role"), F.regexp_replace(compiled(m["content"], known, missing), BLANKS, "").alias("content")) for m in template]
    if missing:
        raise TemplateError(f"samples lack {sorted(set(missing))}")
    return F.filter(F.array(*messages), lambda m: m["content"] != "").cast(MESSAGE)
