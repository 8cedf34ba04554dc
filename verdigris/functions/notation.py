"""Notation of formulas and of system files, rewritten as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import once

# Signs and letters that stand for names, indices, powers and operations.
SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa",
    "λ": "lambda_", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega", "ℏ": "hbar",
    "₀": "_0", "₁": "_1", "₂": "_2", "₃": "_3", "₄": "_4", "₅": "_5", "₆": "_6", "₇": "_7", "₈": "_8", "₉": "_9",
    "²": "**2", "³": "**3", "⁴": "**4", "½": "*0.5", "^": "**", "·": "*", "×": "*", "✕": "*", "÷": "/", "−": "-", "–": "-", "$": " ",
}
# Commands that are names and keep them.
NAMES = (
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "mu", "nu", "xi", "pi", "rho", "varrho", "sigma", "varsigma", "tau", "upsilon",
    "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega", "hbar", "ell",
)
# Commands and words that are written otherwise, commands with their backslash.
WORDS = {
    "\\lambda": "lambda_", "\\infty": "oo", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\ln": "log", "ln": "log",
    "arctan": "atan", "arcsin": "asin", "arccos": "acos", "arctan2": "atan2", "power": "Pow", "abs": "Abs",
}
# Commands that only space or style what follows.
SPACING = ("left", "right", "quad", "qquad", "displaystyle", "mathrm", "text", "mathbf", "bm", ",", ";", ":", "!")
# Commands with arguments, with or without a backslash.
FRACTIONS, ROOTS = ("frac", "dfrac", "tfrac"), ("sqrt", "√")
# Prefixes of numeric libraries.
LIBRARIES = "np|numpy|math|sp|sympy"
#: What a formula is read as: a library's prefix, a command, a word up to an index that a letter follows, white space, a number, or a character.
TOKEN = f"\\b(?:{LIBRARIES})\\s*\\.\\s*|\\\\[A-Za-z]+|\\\\.|(?:power|abs)(?=\\s*\\()|[A-Za-z][A-Za-z0-9_]*?(?:_\\d(?=[A-Za-z])|(?![A-Za-z0-9_]))|\\s+|[0-9]+|(?s:.)"
# The sections of a system file; the first of these that a line begins with, case aside, opens it.
SECTIONS = {
    "variables": "variables:", "constants": "constants:", "derivatives": "derivatives:", "equations": "equations:",
    "units_variables": "units of measure of variables", "units_constants": "units of measure of constants", "units_derivatives": "units of measure of derivatives",
    "units_equations": "units of measure of equations", "other_units": "units of measure",
}
BLOCKS = ("equations", "units_equations")


def _meanings() -> Column:
    """What a token is written as; tokens that are not here stand for themselves."""
    known = SYMBOLS | {f"\\{n}": n for n in NAMES} | WORDS | {f"\\{n}": " " for n in SPACING}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def _joined(what: Column, first: Column, inner: Column, text: Column) -> Column:
    """What stands outside a group, with the group that has just been closed behind it."""
    group = (
        F.when(what == "over", F.concat(F.lit("(("), first, F.lit(")/("), inner, F.lit("))")))
        .when((what == "root") & (first != ""), F.concat(F.lit("(("), inner, F.lit(")**(1/("), first, F.lit(")))")))
        .when(what == "root", F.concat(F.lit("(("), inner, F.lit(")**0.5)")))
        .when((what == "root(") & F.contains(inner, F.lit("(")), F.concat(F.lit("sqrt("), inner, F.lit(")")))
        .when(what == "root(", F.concat(F.lit("(("), inner, F.lit(")**0.5)")))
        .when(what == "[", inner)
        .when(what.isin("frac", "index"), F.lit(""))
        .otherwise(F.concat(F.when(what == "exp", F.lit("exp(")).otherwise(F.lit("(")), inner, F.lit(")")))
    )
    return F.concat(text, group)


def _broken_off(what: Column, first: Column) -> Column:
    """What a group that is never closed began with."""
    begun = F.when(what == "frac", F.lit("frac(")).when(what == "over", F.concat(F.lit("frac("), first, F.lit(")("))).when(what.isin("root", "root("), F.lit("sqrt("))
    return begun.when(what == "index", F.lit("sqrt")).when(what == "exp", F.lit("exp(")).when(what == "[", F.lit("")).otherwise(F.lit("("))


FRAME = "struct<what:string,first:string,text:string>"


def plain_math(x: Column) -> Column:
    """LaTeX and Unicode notation as plain infix text; null and empty give an empty string.

    A formula is read token by token, once.  Groups stand on a stack, each with
    the command that it is an argument of, so commands nest to any depth; a
    root in round brackets with others inside stays a call.  A comma between
    two names is a product, a prime a longer name.  A single `name =` at the
    head goes, and so do closing brackets that nothing opened, from the end.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "^\\s+|\\s+$", ""), "^[`$ ]+|[`$ ]+$", "")
    at = F.instr(body, "=")
    body = F.when((F.regexp_count(body, F.lit("=")) == 1) & (at <= 41), F.substr(body, at + 1)).otherwise(body)
    meanings, none = _meanings(), F.lit("")
    state = lambda stack, text, waits, held, gap, comma, word: F.struct(stack.alias("stack"), text.alias("text"), waits.alias("waits"), held.alias("held"), gap.alias("gap"), comma.alias("comma"), word.alias("word"))
    no, yes = F.lit(False), F.lit(True)
    start = state(F.array().cast(f"array<{FRAME}>"), none, none, none, no, no, no)

    def step(s: Column, t: Column) -> Column:
        bare = F.regexp_replace(t, "^\\\\", "")
        said = F.coalesce(F.try_element_at(meanings, t), F.when(F.rlike(t, F.lit(f"^(?:{LIBRARIES})\\s*\\.")), none).otherwise(bare))
        return once(F.struct(bare.alias("bare"), said.alias("said")), lambda w: _spelled(s, t, w["bare"], w["said"]))

    def _spelled(s: Column, t: Column, bare: Column, said: Column) -> Column:
        command = F.when(bare.isin(*FRACTIONS), "frac").when(bare.isin(*ROOTS), "sqrt").when(t == "\\exp", "exp")
        blank, begins = F.rlike(said, F.lit("^\\s+$")), F.rlike(said, F.lit("^[A-Za-z(]"))
        opens, closes = t.isin("{", "(", "["), t.isin("}", ")", "]")
        # a command that waits for its argument, and gets it
        takes = ((s["waits"].isin("frac", "over", "exp") & (t == "{")) | ((s["waits"] == "sqrt") & opens))
        # one that does not get it is written as it is
        lost = F.when(s["waits"] == "over", F.concat(F.lit("frac("), s["held"], F.lit(")"))).when((s["waits"] == "sqrt") & (s["held"] != ""), F.concat(F.lit("sqrt"), s["held"])).otherwise(s["waits"])
        before = F.when((s["waits"] != "") & ~takes & ~blank, F.concat(s["text"], lost)).otherwise(s["text"])
        after = lambda text: F.when(s["comma"] & ~blank, F.concat(text, F.when(begins & F.rlike(F.right(text, F.lit(1)), F.lit("[A-Za-z0-9_)]")), "*").otherwise(","))).otherwise(text)
        known = F.struct(command.alias("command"), blank.alias("blank"), opens.alias("opens"), closes.alias("closes"), takes.alias("takes"))
        return once(known, lambda k: once(once(before, after), lambda text: _gapped(s, t, said, text, k)))

    def _gapped(s: Column, t: Column, said: Column, text: Column, k: Column) -> Column:
        takes = k["takes"]
        gap = F.when(s["gap"] & ~takes & ~(s["comma"] & F.endswith(text, F.lit("*"))), F.lit(" ")).otherwise(none)
        times = lambda gap: F.when((gap == "") & F.rlike(said, F.lit("^[A-Za-z]")) & F.rlike(F.right(text, F.lit(2)), F.lit("_[0-9]")), F.lit("*")).otherwise(none)
        return once(gap, lambda gap: once(F.struct(F.concat(text, gap).alias("spaced"), times(gap).alias("times")), lambda v: _taken(s, t, said, text, v["spaced"], v["times"], k)))

    def _taken(s: Column, t: Column, said: Column, text: Column, spaced: Column, times: Column, k: Column) -> Column:
        command, blank, opens, closes, takes = (k[c] for c in ("command", "blank", "opens", "closes", "takes"))
        top = F.try_element_at(s["stack"], F.lit(-1))
        fits = closes & F.coalesce(F.when(top["what"].isin("(", "root("), t == ")").when(top["what"].isin("[", "index"), t == "]").otherwise(t == "}"), no)
        what = F.when(s["waits"].isin("frac", "over", "exp") & (t == "{"), s["waits"]).when((s["waits"] == "sqrt") & (t == "["), "index").when((s["waits"] == "sqrt") & (t == "("), "root(").when(s["waits"] == "sqrt", "root").otherwise(t)
        pushed = F.concat(s["stack"], F.array(F.struct(what.alias("what"), F.when(takes, s["held"]).otherwise(none).alias("first"), F.when(takes, s["text"]).otherwise(spaced).alias("text"))))
        popped = F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        then = F.when(top["what"] == "frac", "over").when(top["what"] == "index", "sqrt").otherwise("")
        prime = (t == "'") & s["word"]
        stray = F.when(t == "{", "(").when(t == "}", ")").when(t.isin("[", "]"), "").otherwise(said)
        return (
            F.when(blank, state(s["stack"], s["text"], s["waits"], s["held"], yes, s["comma"], no))
            .when(opens, state(pushed, none, none, none, no, no, no))
            .when(fits, state(popped, _joined(top["what"], top["first"], spaced, top["text"]), then, F.when(then != "", spaced).otherwise(none), no, no, no))
            .when(command.isNotNull(), state(s["stack"], F.concat(spaced, times), command, none, no, no, no))
            .when(t == ",", state(s["stack"], text, none, none, s["gap"], yes, no))
            .when(prime, state(s["stack"], F.concat(text, F.lit("_prime")), none, none, no, no, yes))
            .otherwise(state(s["stack"], F.concat(spaced, times, stray), none, none, no, no, F.rlike(said, F.lit("^[A-Za-z]"))))
        )

    def ended(s: Column) -> Column:
        tail = F.when(s["waits"] == "over", F.concat(F.lit("frac("), s["held"], F.lit(")"))).otherwise(F.concat(s["waits"], s["held"]))
        last = F.concat(s["text"], tail, F.when(s["comma"], F.lit(",")).otherwise(none))
        return F.aggregate(F.reverse(s["stack"]), last, lambda text, f: F.concat(f["text"], _broken_off(f["what"], f["first"]), text))

    read = F.aggregate(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), start, step, ended)
    body = F.regexp_replace(F.trim(F.regexp_replace(read, "\\s+", " ")), "[.,;:]+$", "")
    parts = F.split(body, "\\)")
    closers = F.size(parts) - 1
    extra = F.greatest(closers - F.regexp_count(body, F.lit("\\(")), F.lit(0))
    kept = closers - extra + 1
    return F.trim(F.when(extra > 0, F.concat(F.array_join(F.slice(parts, 1, kept), ")"), F.array_join(F.slice(parts, kept + 1, F.greatest(extra, F.lit(1))), ""))).otherwise(body))


def bracketed_list(line: Column) -> Column:
    """The parts of the outermost square brackets, without blanks and quotes."""
    inside = F.regexp_extract(line, "\\[(.*)\\]", 1)
    return F.transform(F.filter(F.split(inside, ","), lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", ""))


def system_sections(x: Column) -> Column:
    """A system file as a map from section to its entries.

    Lists stand on the heading's own line; equations and their units follow
    theirs, a line each, until the next heading.  Of a list that is given twice
    the last counts; unknown lines outside a block are passed over.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\\r?\\n|\\r"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    heads = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(head).alias("head")) for name, head in SECTIONS.items()])
    opened = lambda s: once(F.lower(s), lambda low: F.try_element_at(F.filter(heads, lambda h: F.startswith(low, h["head"])), F.lit(1))["name"])
    start = F.struct(F.lit(None).cast("string").alias("at"), F.array().cast("array<struct<section:string,line:string,opens:boolean>>").alias("found"))

    def step(state: Column, s: Column) -> Column:
        def read(new: Column) -> Column:
            at = F.when(new.isNull(), state["at"]).when(new.isin(*BLOCKS), new)
            row = F.struct(F.coalesce(new, state["at"]).alias("section"), s.alias("line"), new.isNotNull().alias("opens"))
            return F.struct(at.alias("at"), F.concat(state["found"], F.filter(F.array(row), lambda r: r["section"].isNotNull())).alias("found"))

        return once(opened(s), read)

    def sections(found: Column) -> Column:
        of = lambda name: F.filter(found, lambda r: r["section"] == name)
        block = lambda name: F.transform(F.filter(of(name), lambda r: ~r["opens"]), lambda r: r["line"])
        listed = lambda name: F.coalesce(bracketed_list(F.try_element_at(of(name), F.lit(-1))["line"]), F.array().cast("array<string>"))
        return F.map_from_arrays(F.array(*[F.lit(n) for n in SECTIONS if n != "other_units"]), F.array(*[block(n) if n in BLOCKS else listed(n) for n in SECTIONS if n != "other_units"]))

    return once(F.aggregate(lines, start, step)["found"], sections)
