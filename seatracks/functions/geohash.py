"""Geohash cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _bits(precision: int) -> tuple[int, int]:
    return (5 * precision + 1) // 2, 5 * precision // 2


def _scaled(value: Column, half: float, bits: int) -> Column:
    top = (1 << bits) - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor((value + half) / (2 * half) * float(1 << bits)))).cast("bigint")


def _numbers(values) -> Column:
    """An array of numbers, written as SQL: one literal, however long."""
    return F.expr(f"array({', '.join(map(repr, values))})")


def _interleaved(axis: Column, bits: int) -> Column:
    """The bits of a coordinate with a zero between each two: six at a time, from a table."""
    table = _numbers(sum((v >> b & 1) << 2 * b for b in range(6)) for v in range(64))
    out = None
    for at in range(0, bits, 6):
        part = F.shiftleft(F.get(table, F.shiftright(axis, at).bitwiseAND(63).cast("int")).cast("bigint"), 2 * at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def geohash_encode(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Cell of a position; null if either coordinate is."""
    lon_bits, lat_bits = _bits(precision)
    x, y = _interleaved(_scaled(lon.cast("double"), 180.0, lon_bits), lon_bits), _interleaved(_scaled(lat.cast("double"), 90.0, lat_bits), lat_bits)
    code = x.bitwiseOR(F.shiftleft(y, 1)) if lon_bits > lat_bits else F.shiftleft(x, 1).bitwiseOR(y)
    letters = F.lit(ALPHABET)
    return F.concat(*(F.substring(letters, (F.shiftright(code, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(precision - 1, -1, -1)))


def geohash_valid(cell: Column, precision: int = 7) -> Column:
    """True for a cell of the right length and alphabet; false for null."""
    return F.coalesce(cell.rlike(f"^[0-9b-hjkmnp-z]{{{precision}}}$"), F.lit(False))


def decode_sql(cell: str, precision: int = 7) -> str:
    """SQL of the struct(lat, lon) of a valid cell's centre; null otherwise.

    A letter moves the corner of the cell by an amount that follows from its value and place: each coordinate is a sum of
    entries of one small table for each place, and exact, as all of them are fractions of powers of two.
    """
    lon_bits, lat_bits = _bits(precision)
    sums: dict[str, list[str]] = {"lat": [], "lon": []}
    for i in range(precision):
        parts: dict[str, list[float]] = {"lat": [], "lon": []}
        for value in range(32):
            moved = {"lat": 0.0, "lon": 0.0}
            for j in range(5):
                bit = 5 * i + j
                axis, span = ("lon", 360.0) if bit % 2 == 0 else ("lat", 180.0)
                moved[axis] += (value >> (4 - j) & 1) * span / (2 << bit // 2)
            for axis, v in moved.items():
                parts[axis].append(v)
        at = f"instr('{ALPHABET}', substr({cell}, {i + 1}, 1)) - 1"
        for axis, values in parts.items():
            sums[axis].append(f"get(array({', '.join(f'{v!r}D' for v in values)}), {at})")
    lat = f"{-90.0 + 90.0 / (1 << lat_bits)!r}D + {' + '.join(sums['lat'])}"
    lon = f"{-180.0 + 180.0 / (1 << lon_bits)!r}D + {' + '.join(sums['lon'])}"
    valid = f"coalesce({cell} rlike '^[0-9b-hjkmnp-z]{{{precision}}}$', false)"
    return f"CASE WHEN {valid} THEN named_struct('lat', {lat}, 'lon', {lon}) END"


def decode_all(cells: Column, precision: int = 7) -> Column:
    """Array of the cells' centres; the expression is parsed from one text, which is much faster than building it call by call."""
    return F.call_function("transform", cells, F.expr(f"c -> {decode_sql('c', precision)}"))


def geohash_decode(cell: Column, precision: int = 7) -> Column:
    """struct(lat, lon) of a valid cell's centre; null otherwise."""
    return F.get(decode_all(F.array(cell), precision), F.lit(0))
