"""Formulas that are equal as such: parsed and evaluated in expressions, nothing runs Python.

A formula's tokens go to postfix order by a fold with an operator stack, and postfix is evaluated by a fold with a
value stack, at one point of each of three prime fields. Two formulas are taken as equal if their values are the
same at all points, which unequal ones of usual size are with a chance below 10^-24.

Each prime p is 2q + 1 with q prime, and every prime number up to 67 is a square modulo p; variables stand for
squares. So the square root that is itself a square is that of the positive number, all roots of odd order exist,
and exponents are computed modulo q, where all fractions exist too. Named functions and pairs are hashes of their
arguments: equal arguments give equal values, no identities of theirs are known. What has no value (a division by
zero, prose, an unknown command, a relation) is equal to nothing.

Understood: numbers, letters, Greek ones, + - * / ^, implied products, fractions, roots, named functions with
brackets, tuples, units in ``\\text``, degrees, thousands separators and a variable assigned on the left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Expressions are SQL text here: they are long, and one parse is faster than a call for each of their parts.
# Fields, and the commands that are understood.
PRIMES = (803460479, 1098701159, 1931011319)
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "log", "ln", "exp")
LETTERS = ("alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "sigma", "tau", "phi", "omega", "pi", "infty")
#: Operators with their rank: tuple, sum, product, sign, power, and the bars of fractions and roots, which bind first.
RANKS = {",": 1, "+": 2, "-": 2, "*": 3, "/": 3, "~": 4, "^": 6, "÷": 8, "√": 8}
BAD = "!"

_WORDS = "|".join((*FUNCTIONS, *LETTERS))
_TOKEN = r"\d+(?:\.\d+)?|\.\d+|\\[a-zA-Z]+|[a-zA-Z]|[-+*/^(),÷√]"
_STEPS = [
    (r"\\(?:left|right|displaystyle|quad|qquad)(?![a-zA-Z])|\\[,!;: ]|\\?[$%]", ""),
    (r"\\(?:text|mathrm|mbox)\s*\{[^{}]*\}|\^\s*\{?\s*\\circ\s*\}?", ""),
    (r"\\[dt]frac", r"\\frac"),
    (r"\\frac\s*(\d|[a-zA-Z])\s*(\d|[a-zA-Z])", r"\\frac{$1}{$2}"),
    (r"\\frac\s*(\d|[a-zA-Z])\s*\{", r"\\frac{$1}{"),
    (r"\\frac\s*(\{[^{}]*\})\s*(\d|[a-zA-Z])", r"\\frac$1{$2}"),
    (rf"(?<![\\a-zA-Z])(sqrt|{_WORDS})(?![a-zA-Z])", r"\\$1"),
    (r"\\sqrt\s*(\d|[a-zA-Z])", r"\\sqrt{$1}"),
    (r"\\sqrt\s*\[([^\[\]]*)\]\s*([{(])", "(1/($1))√$2"),
    (r"\\sqrt\s*([{(])", "(1/2)√$1"),
    (r"\*\*", "^"),
    (r"\\(?:cdot|times|ast)(?![a-zA-Z])|[×·⋅]", "*"),
    (r"\\div(?![a-zA-Z])", "/"),
    ("−", "-"),
    ("π", r"\\pi"),
    (r"(?<=\d),(?=\d{3}(?!\d))", ""),
    (r"^\s*[a-zA-Z]\s*=", ""),
]


def _let(name: str, value: str, body: str) -> str:
    """The body, in which the value goes by a name and is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _listed(xs: object) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_CALLED = ", ".join(rf"r'\{x}'" for x in FUNCTIONS)
_BINARY = _listed(o for o in RANKS if o != "~")


def _plain(text: str) -> str:
    for pattern, by in _STEPS:
        text = f"regexp_replace({text}, r'{pattern}', r'{by}')"
    # a bar for every fraction, or what stands between the braces is something else
    barred = r"translate(regexp_replace(regexp_replace(cleared, r'\\frac(?![a-zA-Z])', ''), r'\}\s*\{', ')÷('), '{}', '()')"
    return _let("cleared", text, rf"CASE WHEN regexp_count(cleared, r'\}}\s*\{{') = regexp_count(cleared, r'\\frac(?![a-zA-Z])') THEN {barred} END")


def _tokens(text: str) -> str:
    bare = rf"regexp_replace(plain, r'\\(?:{_WORDS})(?![a-zA-Z])', '')"
    fine = rf"plain RLIKE r'^(?:(?:{_TOKEN})|\s)+$' AND NOT contains({bare}, r'\') AND NOT {bare} RLIKE '[a-zA-Z]{{3}}' AND NOT plain RLIKE r'\\(?:{'|'.join(FUNCTIONS)})(?![a-zA-Z])\s*(?!\s*\()'"
    found = _let("plain", _plain(text), f"CASE WHEN {fine} THEN regexp_extract_all(plain, r'({_TOKEN})', 1) END")
    # implied products and signs are written out; a number after an operand is none
    ended = rf"coalesce(CASE WHEN i > 0 THEN get(found, i - 1) END RLIKE r'^(?:\d|\.\d|[a-zA-Z)]|\\(?:{'|'.join(LETTERS)})$)', false)"
    product = rf"CASE WHEN t RLIKE r'^(?:[a-zA-Z(]|\\)' THEN array('*', t) WHEN t RLIKE r'^[\d.]' THEN array('{BAD}') ELSE array(t) END"
    sign = "CASE t WHEN '-' THEN array('~') WHEN '+' THEN slice(array(t), 1, 0) ELSE array(t) END"
    return _let("found", found, f"flatten(transform(found, (t, i) -> CASE WHEN {ended} THEN {product} ELSE {sign} END))")


def _rank(t: str) -> str:
    return f"CASE {' '.join(f"WHEN {t} = '{o}' THEN {n}" for o, n in RANKS.items())} WHEN startswith({t}, r'\\') THEN 7 ELSE 0 END"


def _postfix(tokens: str) -> str:
    """Operands before their operators; ``!`` or a bracket is left where brackets don't match."""
    none = "cast(array() AS array<string>)"
    # the place up to which the stack of operators stays
    stays_if = f"CASE WHEN t = ')' THEN o = '(' ELSE o = '(' OR {_rank('o')} < {_rank('t')} OR t = '^' AND o = '^' END"
    stays = f"coalesce(array_max(transform(a.ops, (o, i) -> CASE WHEN {stays_if} THEN i + 1 END)), 0)"
    popped, kept = "reverse(slice(a.ops, k + 1, size(a.ops)))", "slice(a.ops, 1, k)"
    step = f"""CASE WHEN t IN ('(', '~', {_CALLED}) THEN named_struct('out', a.out, 'ops', concat(a.ops, array(t)))
        WHEN t = ')' THEN {_let("k", stays, f"named_struct('out', concat(a.out, CASE WHEN k > 0 THEN {popped} ELSE array('{BAD}') END), 'ops', slice(a.ops, 1, greatest(k - 1, 0)))")}
        WHEN t IN ({_BINARY}) THEN {_let("k", stays, f"named_struct('out', concat(a.out, {popped}), 'ops', concat({kept}, array(t)))")}
        ELSE named_struct('out', concat(a.out, array(t)), 'ops', a.ops) END"""
    return f"aggregate({tokens}, named_struct('out', {none}, 'ops', {none}), (a, t) -> {step}, a -> concat(a.out, reverse(a.ops)))"


_FULL, _HALF = (f"array({', '.join(f'{x}L' for x in xs)})" for xs in (PRIMES, [(p - 1) // 2 for p in PRIMES]))
#: In both fields, and as a whole number where the value is a small one.
VALUE = "struct<m:array<bigint>,q:array<bigint>,n:bigint>"


def _power(base: str, exponent: str, modulus: str) -> str:
    """By squares; exponents from 0 to 2^31 - 1."""
    squares = "named_struct('r', CASE WHEN getbit(pw.e, bit) = 1 THEN pr.r * pr.b % pw.m ELSE pr.r END, 'b', pr.b * pr.b % pw.m)"
    return _let("pw", f"named_struct('b', {base}, 'e', {exponent}, 'm', {modulus})", f"CASE WHEN pw.b IS NOT NULL AND pw.e IS NOT NULL THEN aggregate(sequence(0, 30), named_struct('r', 1L, 'b', pw.b), (pr, bit) -> {squares}, pr -> pr.r) END")


def _calculated(a: str, b: str, modulus: str, exponent: str) -> str:
    """The operator s.op on two values of a field; ``exponent`` is that of a power."""
    powered = f"CASE WHEN w.a <> 0 OR w.e = 0 THEN {_power('w.a', 'w.e', 'w.m')} WHEN w.e > 0 THEN 0L END"
    by_op = f"""CASE s.op WHEN '+' THEN (w.a + w.b) % w.m WHEN '-' THEN (w.a - w.b + w.m) % w.m WHEN '*' THEN w.a * w.b % w.m
        WHEN '/' THEN CASE WHEN w.b <> 0 THEN w.a * {_power("w.b", "w.m - 2", "w.m")} % w.m END WHEN '^' THEN {powered} END"""
    return _let("w", f"named_struct('a', {a}, 'b', {b}, 'm', {modulus}, 'e', {exponent})", by_op)


def _operand(t: str) -> str:
    """A number or a variable."""
    number = lambda fields: f"transform({fields}, m -> CASE WHEN d.scale = 0 THEN cast(d.digits % m AS bigint) ELSE cast(d.digits % m AS bigint) * {_power('10L', 'm - 1 - d.scale', 'm')} % m END)"
    whole = "CASE WHEN d.scale = 0 THEN try_cast(d.digits AS bigint) END"
    digits = f"named_struct('digits', try_cast(replace({t}, '.', '') AS decimal(38,0)), 'scale', CASE WHEN contains({t}, '.') THEN length(substring_index({t}, '.', -1)) ELSE 0 END)"
    variable = f"named_struct('m', transform(transform({_FULL}, (m, i) -> pmod(xxhash64({t}, i), m)), (v, i) -> v * v % get({_FULL}, i)), 'q', transform({_HALF}, (m, i) -> pmod(xxhash64({t}, 'q', i), m)), 'n', cast(NULL AS bigint))"
    return rf"CASE WHEN {t} RLIKE r'^[\d.]' THEN {_let('d', digits, f"named_struct('m', {number(_FULL)}, 'q', {number(_HALF)}, 'n', {whole})")} ELSE {variable} END"


def _applied(t: str, x: str, y: str) -> str:
    """A binary operator on two values; the index of a root stands on its left and is an exponent."""
    operands = f"CASE WHEN {t} = '√' THEN named_struct('op', '^', 'a', {y}, 'b', {x}) ELSE named_struct('op', CASE WHEN {t} = '÷' THEN '/' ELSE {t} END, 'a', {x}, 'b', {y}) END"
    paired = f"transform(s.a.m, (v, i) -> CASE WHEN v IS NOT NULL AND get(s.b.m, i) IS NOT NULL THEN pmod(xxhash64(',', v, get(s.b.m, i), i), get({_FULL}, i)) END)"
    defined = "s.op <> '^' OR NOT exists(s.a.m, v -> v = 0) OR coalesce(s.b.n >= 0, false)"
    of_value = _calculated("v", "get(s.b.m, i)", f"get({_FULL}, i)", f"coalesce(pmod(s.b.n, get({_FULL}, i) - 1), get(s.b.q, i))")
    of_exponent = _calculated("v", "get(s.b.q, i)", f"get({_HALF}, i)", f"pmod(s.b.n, get({_HALF}, i) - 1)")
    powered = _let("z", "CASE WHEN s.b.n BETWEEN 0 AND 62 THEN pow(cast(s.a.n AS double), cast(s.b.n AS double)) END", "CASE WHEN abs(z) < 9007199254740992D THEN cast(z AS bigint) END")
    whole = f"""CASE s.op WHEN '+' THEN try_add(s.a.n, s.b.n) WHEN '-' THEN try_subtract(s.a.n, s.b.n) WHEN '*' THEN try_multiply(s.a.n, s.b.n)
        WHEN '/' THEN CASE WHEN try_mod(s.a.n, s.b.n) = 0 THEN s.a.n div nullif(s.b.n, 0L) END WHEN '^' THEN {powered} END"""
    both = f"named_struct('m', CASE WHEN s.op = ',' THEN {paired} WHEN {defined} THEN transform(s.a.m, (v, i) -> {of_value}) END, 'q', CASE WHEN s.op <> ',' THEN transform(s.a.q, (v, i) -> {of_exponent}) END, 'n', {whole})"
    return _let("s", operands, both)


def _values(text: str) -> str:
    y, x = "try_element_at(stack, -1)", "try_element_at(stack, -2)"
    minus = lambda part, fields: f"transform({y}.{part}, (v, i) -> pmod(-v, get({fields}, i)))"
    negative = f"named_struct('m', {minus('m', _FULL)}, 'q', {minus('q', _HALF)}, 'n', try_subtract(0L, {y}.n))"
    called = f"named_struct('m', transform({y}.m, (v, i) -> CASE WHEN v IS NOT NULL THEN pmod(xxhash64(t, v, i), get({_FULL}, i)) END), 'q', cast(NULL AS array<bigint>), 'n', cast(NULL AS bigint))"
    under = lambda n: f"slice(stack, 1, greatest(size(stack) - {n}, 0))"
    pushed = lambda rest, value: f"concat({rest}, array(cast({value} AS {VALUE})))"
    step = f"""CASE WHEN t = '~' THEN {pushed(under(1), negative)} WHEN t IN ({_CALLED}) THEN {pushed(under(1), called)} WHEN t IN ({_BINARY}) THEN {pushed(under(2), _applied("t", x, y))}
        WHEN t IN ('(', '{BAD}') THEN {pushed("stack", "NULL")} ELSE {pushed("stack", _operand("t"))} END"""
    stack = f"aggregate({_postfix(_tokens(text))}, cast(array() AS array<{VALUE}>), (stack, t) -> {step})"
    return _let("stack", stack, "CASE WHEN size(stack) = 1 AND forall(get(stack, 0).m, v -> v IS NOT NULL) THEN get(stack, 0).m END")


def _of(c: Column, name: str, body: str) -> Column:
    """An expression in SQL text over one value."""
    return F.get(F.call_function("transform", F.array(c), F.expr(f"{name} -> {body}")), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Tokens with implied products and signs written out; null for what is no formula."""
    return _of(col(c), "f", _tokens("f"))


def postfix(c: Column | str) -> Column:
    return _of(col(c), "f", _postfix(_tokens("f")))


def values(c: Column | str) -> Column:
    """The formula's value at the point of each field; null if it has none."""
    return _of(col(c), "f", _values("f"))


def equal(a: Column | str, b: Column | str) -> Column:
    """Whether both are formulas of equal value with the same square brackets; never null."""
    shape = lambda x: rf"regexp_replace({x}, r'\\sqrt\s*\[[^\[\]]*\]|[^\[\]]', '')"
    # intervals: a square bracket beside a comma counts as a round one, its shape has been compared
    rounded = r"regexp_replace(regexp_replace(f, r'(?<!sqrt)\[([^\[\]]*,)', '($1'), r'(,[^\[\]]*)\]', '$1)')"
    both = f"transform(array(pair.a, pair.b), f -> {_values(rounded)})"
    same = f"{shape('pair.a')} = {shape('pair.b')} AND {_let('two', both, 'get(two, 0) = get(two, 1)')}"
    return F.coalesce(_of(F.struct(col(a).alias("a"), col(b).alias("b")), "pair", same), F.lit(False))
