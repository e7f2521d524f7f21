"""Band arithmetic given as text, and masks of quality bits."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geo import bits

_CALLS = {"sqrt": F.sqrt, "exp": F.exp, "log": F.log, "abs": F.abs, "min": F.least, "max": F.greatest}
_OPS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide, ast.Pow: F.pow,
}


def band_expression(text: str, band: Callable[[str], Column] = F.col) -> Column:
    """A column from arithmetic such as "(b('B8') - b('B4')) / (b('B8') + b('B4'))".

    Only numbers, bands, + - * / ** and a few functions are taken; anything else raises. A division by zero gives null.
    """

    def of(e: ast.expr) -> Column:
        match e:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                return _OPS[type(op)](of(a), of(b))
            case ast.Call(func=ast.Name(id="b"), args=[ast.Constant(value=str() as name)], keywords=[]):
                return band(name)
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _CALLS and args:
                return _CALLS[f](*map(of, args))
        raise ValueError(f"not band arithmetic: {ast.unparse(e)}")

    return of(ast.parse(text, mode="eval").body)


def scene_class_mask(scl, cloud, masked: tuple[int, ...], most: float) -> Column:
    """True where the scene class isn't masked and the cloud probability, 100 where unknown, is under `most`."""
    return ~scl.isin(*masked) & (F.coalesce(cloud, F.lit(100.0)) < most)


def bits_clear(value, first: int, last: int, most: int = 0) -> Column:
    """True where the number in bits first..last is at most `most`."""
    return bits(value, first, last) <= most


def masked(value, ok) -> Column:
    """The value where ok is true, else null."""
    return F.when(ok, value)


def days_since_burn(burn_doy, ts) -> Column:
    """Days from the burn to the time, within a year; -1 where nothing burnt."""
    return F.when(burn_doy <= 0, -1).otherwise(F.dayofyear(ts) - burn_doy)
