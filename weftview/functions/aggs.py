"""Aggregate helpers."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_join(value: Column | str, order: list[str], sep: str = "",
                 where: Column | str | None = None) -> Column:
    """Aggregate: non-NULL ``value``s joined by ``sep`` in ``order``; NULL when none.

    The same result as ``listagg(value, sep) WITHIN GROUP (ORDER BY order)
    [FILTER (WHERE where)]``, computed as ``collect_list`` of ``(order..., value)``
    structs, ``array_sort`` and ``array_join``, which measured faster here.
    ``where`` is a boolean column or its name.  With names only, the expression
    is built once per process.
    """
    if isinstance(value, str) and (where is None or isinstance(where, str)):
        return _ordered_join_named(value, tuple(order), sep, where)
    return _ordered_join(value, order, sep, F.col(where) if isinstance(where, str) else where)


@cache
def _ordered_join_named(value: str, order: tuple[str, ...], sep: str, where: str | None) -> Column:
    return _ordered_join(F.col(value), list(order), sep, F.col(where) if where else None)


def _ordered_join(value: Column | str, order: list[str], sep: str, where: Column | None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    item = F.struct(*[F.col(c) for c in order], v.alias("_v"))
    keep = v.isNotNull() if where is None else (v.isNotNull() & where)
    arr = F.array_sort(F.collect_list(F.when(keep, item)))
    return F.when(F.size(arr) > 0, F.array_join(F.transform(arr, lambda x: x["_v"]), sep))
