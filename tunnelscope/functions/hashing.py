"""Sketch hashing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SketchGeometry

MAX_TEID = 2**32 - 1
MAX_QFI = 255


def valid_flow_key(teid: Column, qfi: Column) -> Column:
    """True where the key fits its wire form (32-bit tunnel id, 8-bit class)."""
    return teid.between(0, MAX_TEID) & qfi.between(0, MAX_QFI)


def flow_key_hex(teid: str, qfi: str, row: str | None = None) -> str:
    """Hex text of ``[row byte] tunnel id (4 bytes, big endian) class (1 byte)``, as SQL text."""
    packed = f"shiftleft(CAST({teid} AS BIGINT), 8) + {qfi}"
    if row is None:
        return f"lpad(hex({packed}), 10, '0')"
    return f"lpad(hex(shiftleft(CAST({row} AS BIGINT), 40) + {packed}), 12, '0')"


def flow_crc(teid: str, qfi: str, row: str) -> Column:
    """CRC-32 of the row byte followed by the flow key bytes."""
    return F.expr(f"crc32(unhex({flow_key_hex(teid, qfi, row)}))")


def cms_bucket(teid: str, qfi: str, row: str, width: int) -> Column:
    """Bucket of a flow in one hash row."""
    return F.expr(f"CAST(pmod(crc32(unhex({flow_key_hex(teid, qfi, row)})), {width}L) AS INT)")


# CRC-16 with the reflected polynomial and a zero start, over 2 bits of hash row, 32 of tunnel id and 6 of class.
CRC16_POLYNOMIAL = 0xA001
SWITCH_KEY_BYTES = 5
SWITCH_ROWS = 4
MAX_SWITCH_WIDTH = 1 << 16


def crc16(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (CRC16_POLYNOMIAL if crc & 1 else 0)
    return crc


def switch_key(teid: str, qfi: str, row: str) -> str:
    """The 40-bit key as SQL text."""
    return f"(shiftleft(CAST({row} AS BIGINT) & 3L, 38) | shiftleft(CAST({teid} AS BIGINT) & 4294967295L, 6) | (CAST({qfi} AS BIGINT) & 63L))"


def switch_crc(teid: str, qfi: str, row: str, bits: int = 16) -> Column:
    """The low ``bits`` of the switch's checksum of a flow in one hash row.

    A checksum that starts from zero is linear: each of its bits is the parity of those key bits that set it.
    """
    ones = [crc16((1 << i).to_bytes(SWITCH_KEY_BYTES, "big")) for i in range(8 * SWITCH_KEY_BYTES)]
    masks = [sum(1 << i for i, crc in enumerate(ones) if crc >> bit & 1) for bit in range(bits)]
    key = switch_key(teid, qfi, row)
    return F.expr(" | ".join(f"shiftleft(bit_count({key} & {mask}L) & 1, {bit})" for bit, mask in enumerate(masks)))


def switch_bucket(teid: str, qfi: str, row: str, width: int) -> Column:
    """Bucket of a flow as the switch addresses it: the low bits of the checksum."""
    if width & (width - 1) or not 0 < width <= MAX_SWITCH_WIDTH:
        raise ValueError("the switch addresses a power of two of up to 65536 buckets")
    if width == 1:
        return F.lit(0)
    return switch_crc(teid, qfi, row, width.bit_length() - 1).cast("int")


def flow_bucket(teid: str, qfi: str, row: str, geometry: SketchGeometry) -> Column:
    """Bucket of a flow under the hash family of a sketch."""
    if geometry.hashing == "crc32":
        return cms_bucket(teid, qfi, row, geometry.width)
    if geometry.hashing != "switch":
        raise ValueError(f"no hash family {geometry.hashing!r}")
    if geometry.depth > SWITCH_ROWS:
        raise ValueError("the switch has two bits for a hash row")
    return switch_bucket(teid, qfi, row, geometry.width)
