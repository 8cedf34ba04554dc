"""Templates with conditions and loops."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.functions.templates import TemplateError, compiled

ROWS = [("ann", ["x", "y"], 3, True, None, [["a", "b"], []]), ("", [], 0, False, "set", None), ("0", None, -1, None, "", [["c"]])]
SCHEMA = "name string, xs array<string>, n int, ok boolean, note string, deep array<array<string>>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("{{ name }}-{{n}}", ["ann-3", "-0", "0--1"]),
        ("{% if name %}yes{% else %}no{% endif %}", ["yes", "no", "yes"]),
        ("{% if xs %}list{% elif note %}note{% else %}none{% endif %}", ["list", "note", "none"]),
        ("{% if n and ok or note == 'set' %}1{% endif %}", ["1", "1", ""]),
        ("{% if not (n and ok) %}1{% endif %}", ["", "1", "1"]),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", ["1x,2y", "", ""]),
        ("{% for d in deep %}<{% for x in d %}{{ x }}{{ name }}{% endfor %}>{% endfor %}", ["<aannbann><>", "", "<c0>"]),
        ("{{ xs | join(', ') }}|{{ note | default('?') }}|{{ name | upper }}|{{ xs | length }}", ["x, y|?|ANN|2", "|set||0", "||0|"]),
        ("{{ xs | enumerate_options }}", ["A) x\nB) y", "", ""]),
        ("a\n  {% if ok %}\nb\n  {% endif %}\nc{# gone #}", ["a\nb\nc", "a\nc", "a\nc"]),
        ("{% if 'x' in xs %}has{% endif %}{% if n != 3 %}!{% endif %}", ["has", "!", "!"]),
    ],
)
def test_compiled(rows, body, want):
    names = {c.split()[0]: F.col(c.split()[0]) for c in SCHEMA.split(", ")}
    missing: list[str] = []
    got = rows(SCHEMA, ROWS, compiled(body, names, missing))
    assert [g[0] for g in got] == want and missing == []


def test_names_that_are_missing_anywhere():
    missing: list[str] = []
    compiled("{% if a %}{{ b }}{% else %}{% for x in c %}{{ x }}{{ d }}{% endfor %}{% endif %}", {"a": F.lit(1), "c": F.array()}, missing)
    assert sorted(set(missing)) == ["b", "d"]
    for bad in ("{% if a %}", "{% endfor %}", "{{ }}", "{{ a | }}", "{{ a ~ b }}"):
        with pytest.raises(TemplateError):
            compiled(bad, {"a": F.lit(1)}, [])
