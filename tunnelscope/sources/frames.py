"""Tunnel id and class out of raw Ethernet frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import unsigned_be

# Fixed values of the protocols involved.
ETHER_IPV4 = 0x0800
IP_TCP = 6
IP_UDP = 17
PORT_N3 = 2152
EXT_SESSION_CONTAINER = 0x85
EXT_SESSION_CONTAINER_LEN = 1
ETH_BYTES, IPV4_BYTES, UDP_BYTES, TUNNEL_BYTES, OPTION_BYTES = 14, 20, 8, 8, 4

_IP = ETH_BYTES
_L4 = _IP + IPV4_BYTES
_TUNNEL = _L4 + UDP_BYTES
_OPTIONS = _TUNNEL + TUNNEL_BYTES
_EXTENSION = _OPTIONS + OPTION_BYTES


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Add header fields and ``teid``, ``qfi``; both are 0 where their layer is missing.

    Each layer is read only if the one before names it. The network header counts as 20 bytes.
    """
    raw = F.col(frame)

    def field(offset: int, length: int) -> Column:
        return F.when(F.length(raw) >= offset + length, unsigned_be(raw, offset, length))

    ether_type = field(12, 2)
    is_ip = ether_type == ETHER_IPV4
    protocol = F.when(is_ip, field(_IP + 9, 1))
    has_ports = protocol.isin(IP_TCP, IP_UDP)
    dst_port = F.when(has_ports, field(_L4 + 2, 2))
    in_tunnel = (protocol == IP_UDP) & (dst_port == PORT_N3)
    flags = F.when(in_tunnel, field(_TUNNEL, 1))
    has_options = flags.bitwiseAND(F.lit(0x7)) != 0
    container = (
        has_options
        & (field(_OPTIONS + 3, 1) == EXT_SESSION_CONTAINER)
        & (field(_EXTENSION, 1) == EXT_SESSION_CONTAINER_LEN)
    )
    zero = F.lit(0).cast("bigint")
    qfi = F.when(container, field(_EXTENSION + 2, 1).bitwiseAND(F.lit(0x3F)))
    return frames.withColumns(
        {
            "ether_type": ether_type,
            "protocol": protocol,
            "src_addr": F.when(is_ip, field(_IP + 12, 4)),
            "dst_addr": F.when(is_ip, field(_IP + 16, 4)),
            "src_port": F.when(has_ports, field(_L4, 2)),
            "dst_port": dst_port,
            "teid": F.coalesce(F.when(in_tunnel, field(_TUNNEL + 4, 4)), zero),
            "qfi": F.coalesce(qfi, zero),
        }
    ).drop(frame)
