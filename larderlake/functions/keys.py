"""Key order, paging bounds and stripes.

Two orders: `bytes` is plain unsigned order of pk, then sk, a missing sk first;
`encoded` sorts shorter keys first, and a missing sk equals an empty one.
Bounds use the same terms as the sort, so pages neither lose nor repeat rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..model import KEY_ORDERS

STRIPES = 256


def terms(mode: str = "bytes", pk: str = "pk", sk: str | None = "sk") -> list[Column]:
    """Columns whose order is the key order; none is null where pk isn't."""
    if mode not in KEY_ORDERS:
        raise InvalidArgument(f"key order {mode!r}")
    p, s = F.col(pk), F.col(sk) if sk else None
    if mode == "bytes":
        return [p] + ([s.isNotNull(), s] if sk else [])
    empty = F.coalesce(s, F.lit("")) if sk else None
    return [F.octet_length(p), p] + ([F.octet_length(empty), empty] if sk else [])


def values(key: tuple, mode: str = "bytes") -> list[Column]:
    """The terms of a key (pk, sk or None), as literals."""
    pk, sk = key if len(key) == 2 else (key[0], None)
    size = lambda x: len(x.encode() if isinstance(x, str) else bytes(x))
    if mode == "bytes":
        return [F.lit(pk), F.lit(sk is not None), F.lit(sk)]
    return [F.lit(size(pk)), F.lit(pk), F.lit(size(sk or "")), F.lit(sk or "")]


def order(mode: str = "bytes", reverse: bool = False, pk: str = "pk", sk: str | None = "sk") -> list[Column]:
    """Sort columns; reverse turns every term round."""
    return [(t.desc_nulls_last() if reverse else t.asc_nulls_first()) for t in terms(mode, pk, sk)]


def beyond(key: tuple, mode: str = "bytes", reverse: bool = False, pk: str = "pk", sk: str | None = "sk") -> Column:
    """Whether a row comes after `key` (exclusive) in key order, or in reverse order."""
    left, right = terms(mode, pk, sk), values(key, mode)
    out, same = F.lit(False), F.lit(True)
    for a, b in zip(left, right):
        further = (a < b) if reverse else (a > b)
        out = out | (same & F.coalesce(further, F.lit(False)))
        same = same & a.eqNullSafe(b)
    return out


def stripe(pk: str = "pk") -> Column:
    """crc32 of the pk's bytes modulo 256."""
    return (F.crc32(F.col(pk).cast("binary")) % STRIPES).cast("int")
