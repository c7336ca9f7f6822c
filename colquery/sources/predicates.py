"""What a source can do with a filter, and int4 filters evaluated on record batches.

A filter is EXACT (the source applies it, nothing is rechecked), PRUNE_ONLY
(the source may skip storage by it, Spark rechecks rows) or UNSUPPORTED (left to
Spark). The source's grammar: one int column, int constants, ``+ - * / %``,
unary minus and one comparison, ``(c2 + 3) * 2 > 20`` say.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc

EXACT, PRUNE_ONLY, UNSUPPORTED = "EXACT", "PRUNE_ONLY", "UNSUPPORTED"
OPS = ("=", "<>", "<", "<=", ">", ">=")
_COMPARE = {ast.Eq: pc.equal, ast.NotEq: pc.not_equal, ast.Lt: pc.less, ast.LtE: pc.less_equal, ast.Gt: pc.greater, ast.GtE: pc.greater_equal}


def _remainder(a, b):
    return pc.subtract_checked(a, pc.multiply_checked(pc.divide_checked(a, b), b))


_ARITHMETIC = {ast.Add: pc.add_checked, ast.Sub: pc.subtract_checked, ast.Mult: pc.multiply_checked, ast.Div: pc.divide_checked, ast.Mod: _remainder}


@dataclass
class BatchFilter:
    """A filter in the grammar: its column and its tree."""

    column: str
    tree: ast.Compare

    def mask(self, values: pa.Array) -> pa.Array:
        """Int4 semantics: overflow and division by zero raise, null is not true."""
        return _COMPARE[type(self.tree.ops[0])](self._value(self.tree.left, values), self._value(self.tree.comparators[0], values))

    def _value(self, node, values):
        if isinstance(node, ast.Name):
            return values
        if isinstance(node, ast.Constant):
            return pa.scalar(node.value, pa.int32())
        if isinstance(node, ast.UnaryOp):
            return pc.negate_checked(self._value(node.operand, values))
        return _ARITHMETIC[type(node.op)](self._value(node.left, values), self._value(node.right, values))


def parse(text: str) -> BatchFilter | None:
    """The filter, or None if it isn't in the grammar."""
    plain = text.replace("<>", "!=")
    if "==" not in plain and "=" in plain.replace("<=", "").replace(">=", "").replace("!=", ""):
        plain = plain.replace("<=", "\0").replace(">=", "\1").replace("!=", "\2").replace("=", "==").replace("\0", "<=").replace("\1", ">=").replace("\2", "!=")
    try:
        tree = ast.parse(plain.strip(), mode="eval").body
    except SyntaxError:
        return None
    if not (isinstance(tree, ast.Compare) and len(tree.ops) == 1 and type(tree.ops[0]) in _COMPARE):
        return None
    names: set[str] = set()

    def fits(node) -> bool:
        if isinstance(node, ast.Name):
            names.add(node.id)
            return True
        if isinstance(node, ast.Constant):
            return type(node.value) is int and abs(node.value) < 2**31
        if isinstance(node, ast.UnaryOp):
            return isinstance(node.op, ast.USub) and fits(node.operand)
        return isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC and fits(node.left) and fits(node.right)

    ok = fits(tree.left) and fits(tree.comparators[0])
    return BatchFilter(names.pop(), tree) if ok and len(names) == 1 else None


def predicate_text(predicate) -> str:
    col, op, value = predicate
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    return f"{col} {op} {int(value)}"


def classify(mode: str, columns, *, predicate=None, text: str | None = None) -> str:
    """Of a (column, operator, int) predicate or of filter text, for a snapshot read in ``mode``."""
    if mode == "batch":
        return UNSUPPORTED
    if predicate is not None:
        if predicate[0] not in columns:
            return UNSUPPORTED
        return EXACT if mode == "filter" else PRUNE_ONLY
    found = parse(text or "")
    return EXACT if mode == "filter" and found is not None and found.column in columns else UNSUPPORTED
