"""Formulas as they are written, and as plain infix text."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import notation

CASES = {
    '$y = \\frac{5}{x}$.': '((5)/(x))',
    '\\dfrac{\\sqrt{5} a}{b}': '((((5)**0.5) a)/(b))',
    '`α₁ · x²`': 'alpha_1 * x**2',
    'np.arctan(\\pi\\cdot5))': 'atan(pi*5)',
    "\\lambda + t'": 'lambda_ + t_prime',
    '\\sqrt[3]{x+1}': '((x+1)**(1/(3)))',
    'sqrt(a+b)': '((a+b)**0.5)',
    'sqrt((a+b)*c)': 'sqrt((a+b)*c)',
    '√{x}': '((x)**0.5)',
    '\\left( x \\right)': '( x )',
    'epsilon_0E_0': 'epsilon_0*E_0',
    'ε₀E': 'epsilon_0*E',
    'a,b': 'a*b',
    'f(x\\, y)': 'f(x y)',
    'mu G M_m': 'mu G M_m',
    'x^{2}': 'x**(2)',
    '\\exp{-x}': 'exp(-x)',
    '2\\times3': '2*3',
    '\\ln x': 'log x',
    'power (x,2)': 'Pow (x,2)',
    'abs(x)': 'Abs(x)',
    '': '',
    None: '',
    'a = b = c': 'a = b = c',
    '[1]': '1',
    '\\frac{a_{0}}{b}': '((a_(0))/(b))',
    '\\frac{a': 'frac(a',
    "x_1'": 'x_1_prime',
    'numpy.sqrt(2)': '((2)**0.5)',
    'λ': 'lambda_',
    '\\varepsilon': 'varepsilon',
    'a ½': 'a *0.5',
    '\\mathrm{kg}': '(kg)',
    '1, 2': '1, 2',
    '\\foo x': 'foo x',
    'x − 1': 'x - 1',
    '\\alpha\\beta': 'alphabeta',
    'sqrt x': 'sqrt x',
    r"\frac{\frac{\sqrt{\frac{1}{x}}}{2}}{\sqrt[3]{y}}": "((((((((1)/(x)))**0.5))/(2)))/(((y)**(1/(3)))))",
    "a) + b)": "a + b",
    "x" * 9000: "x" * 9000,
}


def test_plain_math(rows):
    found = rows("k int, x string", [(k, x) for k, x in enumerate(CASES)], "k", notation.plain_math(F.col("x")))
    assert {k: got for k, got in found} == dict(enumerate(CASES.values()))
