"""The rules' arithmetic as checked Spark expressions: a whitelist of names and functions, nothing else."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 64
FUNCTIONS = {
    "min": (2, 99, lambda *x: F.least(*x)),
    "max": (2, 99, lambda *x: F.greatest(*x)),
    "clamp": (3, 3, lambda x, lo, hi: F.greatest(lo, F.least(hi, x))),
    "abs": (1, 1, F.abs),
    "round": (1, 1, lambda x: F.floor(x + 0.5).cast("double")),
    "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "ceil": (1, 1, lambda x: F.ceil(x).cast("double")),
}


def expression(text: str, names: dict[str, Column]) -> Column:
    """`text` over the given names as a double column; ValueError for anything that is not on the list. x / 0 is null."""

    def build(node: ast.expr, depth: int) -> Column:
        if depth > DEPTH:
            raise ValueError("too deep")
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in names:
                raise ValueError(f"unknown name {node.id}")
            return names[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            x = build(node.operand, depth + 1)
            return -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub | ast.Mult | ast.Div):
            a, b = build(node.left, depth + 1), build(node.right, depth + 1)
            if isinstance(node.op, ast.Div):
                return F.when(b != 0, a / b)
            return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            least, most, f = FUNCTIONS[node.func.id]
            if least <= len(node.args) <= most:
                return f(*[build(x, depth + 1) for x in node.args])
        raise ValueError(f"not allowed: {ast.unparse(node)}")

    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, RecursionError) as e:
        raise ValueError(f"no expression: {text}") from e
    return build(tree, 0)


def resolved(variables: dict[str, tuple[str, float, float]], given: dict[str, Column]) -> dict[str, Column]:
    """Variables (text, least, most) in their order, each over those before it, clamped to its range."""
    out = dict(given)
    for name, (text, lo, hi) in variables.items():
        out[name] = F.greatest(F.lit(lo), F.least(F.lit(hi), expression(text, out)))
    return out
