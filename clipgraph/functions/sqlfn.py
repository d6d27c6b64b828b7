"""Vector helpers as SQL functions. The bodies are native expressions; no Python runs per row."""
from __future__ import annotations

from pyspark.sql import SparkSession

from clipgraph.functions import arrays as A

_V = "ARRAY<DOUBLE>"


def register_functions(spark: SparkSession, prefix: str = "cg_") -> list[str]:
    """Create temporary functions dot, l2, cosine, argmax, entropy, sharpen, pool, normalize under a prefix."""
    bodies = {
        "dot": (f"a {_V}, b {_V}", "DOUBLE", A.dot("a", "b")),
        "l2": (f"a {_V}", "DOUBLE", A.norm("a")),
        "cosine": (f"a {_V}, b {_V}", "DOUBLE", A.cosine("a", "b")),
        "argmax": (f"a {_V}", "INT", "CAST(array_position(a, array_max(a)) - 1 AS INT)"),
        "entropy": (f"p {_V}", "DOUBLE", A.entropy("p")),
        "normalize": (f"p {_V}", _V, A.normalize("p")),
        "sharpen": (f"p {_V}, t DOUBLE", _V, A.divide_by_sum(A.each("p", lambda x: f"pow(greatest({x}, 1e-9D), t)"))),
        "pool": (f"p {_V}, v {_V}, g DOUBLE", _V, A.pool("p", "v", "g")),
    }
    for name, (args, returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {returns} RETURN {body}")
    return [prefix + n for n in bodies]
