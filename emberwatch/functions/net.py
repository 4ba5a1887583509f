"""IPv4 arithmetic, private ranges and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRIVATE_PREFIXES = r"^(10\.|192\.168\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)"
EARTH_RADIUS_KM = 6371
_OCTET = r"0*(25[0-5]|2[0-4]\d|1?\d{1,2})"
BYTES_PER_MB = 1048576


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as BIGINT, NULL unless four octets of 0-255."""
    number = F.lit(0).cast("bigint")
    for i in (1, 2, 3, 4):
        number = number * 256 + F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(ip.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}\z"), number)


def is_private(ip: Column) -> Column:
    """True for loopback, link-local and RFC 1918 addresses, by text prefix."""
    return F.coalesce(ip.rlike(PRIVATE_PREFIXES), F.lit(False))


def network_base(number: Column, bits: Column) -> Column:
    """The address with its host bits cleared."""
    host = F.call_function("shiftright", F.lit(0xFFFFFFFF).cast("bigint"), bits)
    return number.bitwiseAND(F.bitwise_not(host))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km; NULL unless both places are known."""
    lat_half = F.radians(lat2 - lat1) / 2
    lon_half = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(lat_half), 2) + F.pow(F.sin(lon_half), 2) * F.cos(
        F.radians(lat1)
    ) * F.cos(F.radians(lat2))
    # least() passes over NULLs
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def megabytes(total: Column) -> Column:
    """Bytes as megabytes with one decimal, as text."""
    exact = total.cast("decimal(30,0)") / F.lit(BYTES_PER_MB).cast("decimal(10,0)")
    return F.round(exact, 1).cast("decimal(30,1)").cast("string")
