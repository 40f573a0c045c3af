"""Column selectors: predicates on names and type names, with set algebra. Results keep the frame's column order."""

from __future__ import annotations

import re
from collections.abc import Callable

from gridlark.functions.expr import Context, Expr, quoted


class Selector(Expr):
    def __init__(self, test: Callable[[str, str], bool]):
        self.test = test
        super().__init__(lambda ctx: [(n, quoted(n)) for n in self.names(ctx)])

    def names(self, ctx: Context) -> list[str]:
        return [n for n, t in ctx.columns if self.test(n, t)]

    def __or__(self, o):
        return Selector(lambda n, t: self.test(n, t) or o.test(n, t)) if isinstance(o, Selector) else super().__or__(o)

    def __and__(self, o):
        return Selector(lambda n, t: self.test(n, t) and o.test(n, t)) if isinstance(o, Selector) else super().__and__(o)

    def __sub__(self, o):
        return Selector(lambda n, t: self.test(n, t) and not o.test(n, t)) if isinstance(o, Selector) else super().__sub__(o)

    def __xor__(self, o):
        return Selector(lambda n, t: self.test(n, t) != o.test(n, t)) if isinstance(o, Selector) else super().__xor__(o)

    def __invert__(self):
        return Selector(lambda n, t: not self.test(n, t))


def _typed(pattern: str):
    compiled = re.compile(pattern)
    return lambda: Selector(lambda n, t: bool(compiled.match(t)))


numeric, integer = _typed(r"([iu]\d+|f\d+)$"), _typed(r"[iu]\d+$")
signed_integer, unsigned_integer, float_ = _typed(r"i\d+$"), _typed(r"u\d+$"), _typed(r"f\d+$")
string, boolean, binary, categorical = _typed(r"str$"), _typed(r"bool$"), _typed(r"binary$"), _typed(r"(cat|enum)$")
date, datetime, time, duration, temporal = _typed(r"date$"), _typed(r"datetime"), _typed(r"time$"), _typed(r"duration"), _typed(r"(date|datetime|time|duration)")
list_, struct = _typed(r"list\["), _typed(r"struct\[")


def all_() -> Selector:
    return Selector(lambda n, t: True)


def by_name(*names: str) -> Selector:
    return Selector(lambda n, t: n in names)


def by_dtype(*dtypes: str) -> Selector:
    return Selector(lambda n, t: t in dtypes)


def exclude(*names: str) -> Selector:
    return Selector(lambda n, t: n not in names)


def starts_with(*parts: str) -> Selector:
    return Selector(lambda n, t: n.startswith(parts))


def ends_with(*parts: str) -> Selector:
    return Selector(lambda n, t: n.endswith(parts))


def contains(*parts: str) -> Selector:
    return Selector(lambda n, t: any(p in n for p in parts))


def matches(pattern: str) -> Selector:
    return Selector(lambda n, t: bool(re.search(pattern, n)))
