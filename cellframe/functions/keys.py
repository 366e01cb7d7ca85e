"""Keyed uniform numbers: splitmix64 as a Column (64-bit wrapping arithmetic on limbs, no overflow) and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of splitmix64.
GAMMA = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB
MASK32 = (1 << 32) - 1
MASK64 = (1 << 64) - 1


def splitmix64(x: int) -> int:
    x = (x + GAMMA) & MASK64
    x = ((x ^ (x >> 30)) * MIX1) & MASK64
    x = ((x ^ (x >> 27)) * MIX2) & MASK64
    return x ^ (x >> 31)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _plus(a: Column, c: int) -> Column:
    low = a.bitwiseAND(_long(MASK32)) + _long(c & MASK32)
    return let(low, lambda s: F.shiftleft((F.shiftrightunsigned(a, 32) + _long(c >> 32) + F.shiftright(s, 32)).bitwiseAND(_long(MASK32)), 32).bitwiseOR(s.bitwiseAND(_long(MASK32))))


def _times(a: Column, c: int) -> Column:
    """a * c modulo 2**64; every product of limbs stays below 2**49."""
    ch, cl = c >> 32, c & MASK32

    def low32(x: Column, k: int) -> Column:  # x * k modulo 2**32 for 32-bit x and k
        return (x * _long(k & 0xFFFF) + F.shiftleft((x * _long(k >> 16)).bitwiseAND(_long(0xFFFF)), 16)).bitwiseAND(_long(MASK32))

    def body(v: Column) -> Column:
        al, ah = v.bitwiseAND(_long(MASK32)), F.shiftrightunsigned(v, 32)
        p0, p1 = al * _long(cl & 0xFFFF), al * _long(cl >> 16)
        low = p0 + F.shiftleft(p1.bitwiseAND(_long(0xFFFF)), 16)
        high = F.shiftright(low, 32) + F.shiftright(p1, 16) + low32(al, ch) + low32(ah, cl)
        return F.shiftleft(high.bitwiseAND(_long(MASK32)), 32).bitwiseOR(low.bitwiseAND(_long(MASK32)))

    return let(a, body)


def mix64(x: Column) -> Column:
    """splitmix64 of a long, as a signed long."""
    x = let(x, lambda v: _plus(v, GAMMA))
    x = _times(let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30))), MIX1)
    x = _times(let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27))), MIX2)
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def uniform_key(id_: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) of an id and a seed; null for a null id."""
    h = mix64(id_.cast("long").bitwiseXOR(_long(signed(splitmix64(seed & MASK64)))))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def uniform_key_int(id_: int, seed: int = 0) -> float:
    return (splitmix64((id_ & MASK64) ^ splitmix64(seed & MASK64)) >> 11) * 2.0**-53


def uniform_key_sql(source: str, id_: str, seed: int = 0, name: str = "u") -> str:
    """A SELECT that adds the key of column id_ to the rows of `source`, for engines with 128-bit unsigned integers."""
    mul = lambda a, c: f"((({a} % 4294967296)::UHUGEINT * {c} + ((({a} // 4294967296)::UHUGEINT * {c}) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT"
    unsigned = f"(CASE WHEN {id_} < 0 THEN {id_}::HUGEINT + 18446744073709551616 ELSE {id_}::HUGEINT END)::UBIGINT"
    return f"""SELECT * EXCLUDE (k0, k1, k2, k3), ((xor(k3, k3 >> 31) >> 11)::DOUBLE * {2.0**-53!r}) AS {name} FROM (
  SELECT *, {mul("xor(k2, k2 >> 27)", MIX2)} AS k3 FROM (
    SELECT *, {mul("xor(k1, k1 >> 30)", MIX1)} AS k2 FROM (
      SELECT *, ((k0::UHUGEINT + {GAMMA}) % 18446744073709551616)::UBIGINT AS k1 FROM (
        SELECT *, xor({unsigned}, {splitmix64(seed & MASK64)}::UBIGINT) AS k0 FROM {source}))))"""
