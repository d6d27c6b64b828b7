"""Vector expressions over ARRAY<DOUBLE>, as SQL text.

Every function takes and returns SQL text; ``E`` turns it into a Column. Text composes without one driver call per
node, the same text serves ``selectExpr``, SQL functions and DataFrame code, and everything stays on the JVM.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

_names = count()


def E(text: str) -> Column:
    return F.expr(text)


def num(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def _fresh(n: int) -> list[str]:
    """Lambda variables that no enclosing lambda uses."""
    i = next(_names)
    return [f"v{i}_{j}" for j in range(n)]


def each(a: str, body: Callable[[str], str]) -> str:
    (x,) = _fresh(1)
    return f"transform({a}, {x} -> {body(x)})"


def both(a: str, b: str, body: Callable[[str, str], str]) -> str:
    x, y = _fresh(2)
    return f"zip_with({a}, {b}, ({x}, {y}) -> {body(x, y)})"


def fold(a: str, body: Callable[[str, str], str], zero: str = "0D") -> str:
    s, x = _fresh(2)
    return f"aggregate({a}, {zero}, ({s}, {x}) -> {body(s, x)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times, also inside lambdas (which re-evaluate what they contain)."""
    return f"{each(f'array({value})', body)}[0]"


def to_double(a: str) -> str:
    return f"CAST({a} AS ARRAY<DOUBLE>)"


def vsum(a: str) -> str:
    return fold(a, lambda s, x: f"{s} + {x}")


def dot(a: str, b: str) -> str:
    return vsum(both(a, b, lambda x, y: f"{x} * {y}"))


def norm(a: str) -> str:
    return f"sqrt({fold(a, lambda s, x: f'{s} + {x} * {x}')})"


def scale(a: str, s: str) -> str:
    return let(s, lambda v: each(a, lambda x: f"{x} * {v}"))


def divide(a: str, s: str) -> str:
    """Element-wise quotient; a zero divisor gives nulls rather than an error."""
    return let(f"nullif({s}, 0D)", lambda v: each(a, lambda x: f"{x} / {v}"))


def add(a: str, b: str) -> str:
    return both(a, b, lambda x, y: f"{x} + {y}")


def sub(a: str, b: str) -> str:
    return both(a, b, lambda x, y: f"{x} - {y}")


def zeros(a: str) -> str:
    return f"array_repeat(0D, size({a}))"


def l2_normalize(a: str, eps: float = 1e-8) -> str:
    return let(a, lambda r: divide(r, f"({norm(r)} + {num(eps)})"))


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0D)"


def argmax(p: str) -> str:
    """Index of the largest element, the lowest index on ties."""
    return let(p, lambda r: f"CAST(array_position({r}, array_max({r})) - 1 AS INT)")


def entropy(p: str, eps: float = 1e-12) -> str:
    return "-" + fold(p, lambda s, x: f"{s} + {x} * ln({x} + {num(eps)})")


def divide_by_sum(a: str) -> str:
    return let(a, lambda r: divide(r, vsum(r)))


def normalize(p: str, fallback: str = "zero") -> str:
    """Divide by the sum. Rows without mass become all zero or uniform."""
    def scaled(r: str) -> str:
        other = "0D" if fallback == "zero" else f"1D / size({r})"
        return let(vsum(r), lambda t: f"IF({t} > 0, {each(r, lambda x: f'{x} / {t}')}, {each(r, lambda _: other)})")
    return let(p, scaled)


def floor_log(x: str, floor: float = 1e-9) -> str:
    return f"ln(greatest({x}, {num(floor)}))"


def log_each(p: str, floor: float = 1e-9) -> str:
    return each(p, lambda x: floor_log(x, floor))


def sharpen(p: str, temp: float) -> str:
    if temp == 1.0:
        return p
    return divide_by_sum(each(p, lambda x: f"pow(greatest({x}, {num(1e-9)}), {num(temp)})"))


def softmax(logits: str) -> str:
    """exp of the logits less their largest, divided by the sum."""
    return let(logits, lambda lg: let(f"array_max({lg})", lambda top: divide_by_sum(
        each(lg, lambda x: f"exp({x} - {top})"))))


def pool(q: str, v: str, g: str | float, floor: float = 1e-9) -> str:
    """Log-linear pooling q^(1-g) * v^g, renormalised."""
    g = g if isinstance(g, str) else num(g)
    return let(g, lambda w: softmax(both(
        q, v, lambda x, y: f"(1 - {w}) * {floor_log(x, floor)} + {w} * {floor_log(y, floor)}")))


def one_hot(c: str, n: int) -> str:
    return each(f"sequence(0, {n - 1})", lambda i: f"IF({i} = {c}, 1D, 0D)")


def clean(x: str) -> str:
    """NaN becomes 0 and infinities the largest finite value of their sign."""
    big = num(1.7976931348623157e308)
    return f"IF(isnan({x}), 0D, greatest(least({x}, {big}), -{big}))"


def weighted_sums(p: str, n: int, w: str) -> str:
    """Aggregate: array of sum(w * p[c]). Plain sums, so the aggregation is code-generated."""
    return "array(" + ", ".join(f"sum({w} * {p}[{i}])" for i in range(n)) + ")"


def mean_array(p: str, n: int) -> str:
    return "array(" + ", ".join(f"avg({p}[{i}])" for i in range(n)) + ")"


def corr(a: str, b: str) -> str:
    """Aggregate: Pearson correlation, null where either side is constant."""
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0D)"


def vec_sum(c: str | Column) -> Column:
    """Aggregate: element-wise sum, with map-side partial buffers of one vector per group."""
    return vector_to_array(Summarizer.sum(array_to_vector(E(c) if isinstance(c, str) else c)))


def vec_mean(c: str | Column) -> Column:
    """Aggregate: element-wise mean."""
    return vector_to_array(Summarizer.mean(array_to_vector(E(c) if isinstance(c, str) else c)))


def vec_moments(c: str) -> Column:
    """Aggregate: struct of mean, sample variance and count per element."""
    return Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(E(c)))


def width_of(df, c: str) -> int:
    """Length of the vectors in a column, read from one row."""
    row = df.select(F.size(c).alias("n")).where("n > 0").head(1)
    return int(row[0]["n"]) if row else 0
