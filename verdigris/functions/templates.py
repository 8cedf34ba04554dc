"""Templates with places, conditions and loops, made into one expression when the plan is made.

`{{ a.b | filter }}` is a place; `{% if %}`, `{% elif %}`, `{% else %}` and
`{% for x in xs %}` are blocks; `{# #}` is a comment.  A block's tag takes the
blanks before it on its line and the line break behind it.  Conditions know
not, and, or, ==, != and in.  Nothing is rendered row by row in Python: a
condition is a CASE, a loop a transform of an array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that cannot be read, or that names what its samples do not have."""


TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
WORD = re.compile(r"\s*(==|!=|\||\(|\)|,|\.|'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|[A-Za-z_]\w*)")
#: What counts as nothing, by its text, for values that are not text.
NOTHING = ("", "[]", "{}", "false", "0", "0.0")


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def truth(c: Column) -> Column:
    """Whether a value says something: a text that is not empty, a list with elements, a number other than 0, true."""
    return F.coalesce(F.when(F.typeof(c) == "string", c.cast("string") != "").otherwise(~c.cast("string").isin(*NOTHING)), F.lit(False))


def _lettered(c: Column, start: str = "A") -> Column:
    return F.array_join(F.transform(c.cast("array<string>"), lambda x, i: F.concat(F.char(i + ord(start)), F.lit(") "), F.coalesce(x, F.lit("")))), "\n")


#: Filters by name; arguments are literals.
FILTERS: dict[str, Callable[..., Column]] = {
    "upper": lambda c: F.upper(shown(c)), "lower": lambda c: F.lower(shown(c)), "trim": lambda c: F.regexp_replace(shown(c), "^\\s+|\\s+$", ""),
    "length": lambda c: F.when(F.typeof(c) == "string", F.length(c.cast("string"))).otherwise(F.size(c.cast("array<string>"))), "first": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "join": lambda c, by="": F.array_join(c.cast("array<string>"), by), "default": lambda c, other="": F.coalesce(c.cast("string"), F.lit(other)), "enumerate_options": _lettered,
}


class _Expression:
    """Reads what stands inside a tag, word by word."""

    def __init__(self, source: str, names: Mapping[str, Column], missing: list[str]):
        self.words, at = [], 0
        while source[at:].strip():
            m = WORD.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source.strip()!r}")
            self.words.append(m[1])
            at = m.end()
        self.source, self.names, self.missing = source, names, missing

    def take(self, *words: str) -> str | None:
        return self.words.pop(0) if self.words and (not words or self.words[0] in words) else None

    def need(self, word: str) -> None:
        if self.take(word) is None:
            raise TemplateError(f"{word!r} is missing in {self.source.strip()!r}")

    def literal(self) -> str | float | int:
        word = self.take() or ""
        if word[:1] in "'\"" and word:
            return word[1:-1]
        if re.fullmatch(r"-?\d+(\.\d+)?", word):
            return float(word) if "." in word else int(word)
        raise TemplateError(f"{word!r} is no literal in {self.source.strip()!r}")

    def value(self) -> Column:
        if self.words and not re.match(r"[A-Za-z_]", self.words[0]):
            out = F.lit(self.literal())
        else:
            name = self.take()
            if name is None:
                raise TemplateError(f"nothing to show in {self.source.strip()!r}")
            if name not in self.names:
                self.missing.append(name)
            out = self.names.get(name, F.lit(""))
            while self.take("."):
                out = out[self.take() or ""]
        while self.take("|"):
            name = self.take() or ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            given = []
            if self.take("("):
                while not self.take(")"):
                    given.append(self.literal())
                    self.take(",")
            out = FILTERS[name](out, *given)
        return out

    def test(self) -> Column:
        if self.take("not"):
            return ~self.test()
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        left = self.value()
        which = self.take("==", "!=", "in")
        if which is None:
            return truth(left)
        right = self.value()
        if which == "in":
            return F.coalesce(F.array_contains(right.cast("array<string>"), left.cast("string")), F.lit(False))
        same = left.cast("string").eqNullSafe(right.cast("string"))
        return same if which == "==" else ~same

    def condition(self) -> Column:
        out = self.test()
        while (word := self.take("and", "or")) is not None:
            right = self.test()
            while word == "or" and self.take("and"):  # and binds closer
                right = right & self.test()
            out = out & right if word == "and" else out | right
        return out

    def end(self) -> None:
        if self.words:
            raise TemplateError(f"{' '.join(self.words)!r} is too much in {self.source.strip()!r}")


def compiled(body: str, names: Mapping[str, Column], missing: list[str]) -> Column:
    """The text of a template as a column; names that it lacks are added to `missing`."""
    body = re.sub(r"(%\}|#\})\n", r"\1", re.sub(r"^[ \t]+(?=\{[%#])", "", body, flags=re.MULTILINE))
    pieces = TAG.split(body)

    def whole(source: str, known: Mapping[str, Column], conditional: bool) -> Column:
        e = _Expression(source, known, missing)
        out = e.condition() if conditional else e.value()
        e.end()
        return out

    def block(known: Mapping[str, Column], *ends: str) -> tuple[Column, str]:
        """What stands up to one of the tags `ends`, and that tag."""
        out = [F.lit("")]
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                out.append(shown(whole(piece[2:-2], known, False)))
            elif piece.startswith("{%"):
                tag = piece[2:-2].strip(" \t\n-")
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return F.concat(*out), tag
                if word == "if":
                    out.append(choice(tag[2:], known))
                elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", tag, re.DOTALL)):
                    out.append(loop(m[1], whole(m[2], known, False), known))
                else:
                    raise TemplateError(f"cannot read {{% {tag} %}}")
            elif not piece.startswith("{#"):
                out.append(F.lit(piece))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return F.concat(*out), ""

    def choice(condition: str, known: Mapping[str, Column]) -> Column:
        test = whole(condition, known, True)
        then, tag = block(known, "elif", "else", "endif")
        other = F.lit("")
        if tag.startswith("elif"):
            other = choice(tag[4:], known)
        elif tag == "else":
            other, _ = block(known, "endif")
        return F.when(test, then).otherwise(other)

    def loop(name: str, items: Column, known: Mapping[str, Column]) -> Column:
        before = list(pieces)

        def each(x: Column, i: Column) -> Column:
            pieces[:] = before  # the function may be called again to build the expression
            place = F.struct((i + 1).alias("index"), i.alias("index0"), (i == 0).alias("first"), (i == F.size(items) - 1).alias("last"))
            return block({**known, name: x, "loop": place}, "endfor")[0]

        rows = F.transform(items, each)
        return F.coalesce(F.array_join(rows, ""), F.lit(""))

    return block(names)[0]
