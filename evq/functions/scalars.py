"""Scalar values with one spelling: times, addresses, ASCII case, globs, JSON."""

from __future__ import annotations

import ipaddress
import json
import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)
#: ISO 8601 with date, time, optional fraction and optional zone; no zone is UTC.
TIME_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})?"
_PARTS = re.compile(r"([0-9-]{10})[Tt ]([0-9:]{8})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:?[0-9]{2})?")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


# literals, on the driver


def parse_time(text: str) -> datetime:
    """A naive UTC datetime; digits beyond microseconds are cut off. ValueError if the text isn't a timestamp."""
    found = _PARTS.fullmatch(text.strip())
    if not found or not re.fullmatch(TIME_PATTERN, text.strip()):
        raise ValueError(f"'{text}' is not an ISO 8601 timestamp")
    day, clock, fraction, zone = found.groups()
    when = datetime.fromisoformat(f"{day}T{clock}") + timedelta(microseconds=int((fraction or "0")[:6].ljust(6, "0")))
    if zone and zone not in "Zz":
        hours, minutes = int(zone[1:3]), int(zone[-2:])
        if hours > 23 or minutes > 59:
            raise ValueError(f"'{text}' has no valid zone")
        when -= (1 if zone[0] == "+" else -1) * timedelta(hours=hours, minutes=minutes)
    return when


def show_time(when: datetime) -> str:
    if when.tzinfo:
        when = when.astimezone(timezone.utc).replace(tzinfo=None)
    return when.strftime("%Y-%m-%dT%H:%M:%S.%f").rjust(26, "0") + "Z"


def canonical_time(text: str) -> str:
    return show_time(parse_time(text))


def canonical_ip(text: str) -> str:
    """IPv4, or IPv6 in its short form; brackets go, and a mapped IPv4 address is one. ValueError if it is no address."""
    found = ipaddress.ip_address(text.strip().removeprefix("[").removesuffix("]"))
    return str(getattr(found, "ipv4_mapped", None) or found)


def canonical_cidr(text: str) -> str:
    return str(ipaddress.ip_network(text.strip(), strict=False))


def ascii_fold(text: str) -> str:
    return text.translate(_ASCII)


def canonical_json(value) -> str:
    """Keys in order, no spaces, no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# columns


def ascii_lower(c: Column) -> Column:
    """Only A-Z, unlike ``lower``."""
    return F.translate(c, _UPPER, _LOWER)


def glob_to_like(pattern: str) -> str:
    """A glob (* any run, ? one character, all else itself) as the pattern of SQL's LIKE."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def shown_time(c: Column) -> Column:
    return F.date_format(c, TIME_FORMAT)


def json_scalar(c: Column, kind: str) -> Column:
    """A field as canonical JSON; null as ``null``. Spark writes control characters in upper-case hex, the canonical form has lower case."""
    if kind == "int" or kind == "bool":
        text = c.cast("string")
    elif kind == "time":
        text = F.concat(F.lit('"'), shown_time(c), F.lit('"'))
    else:
        whole = F.to_json(F.struct(c.alias("v")))
        plain = F.substring(whole, F.lit(6), F.length(whole) - 6)
        lower = plain
        for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
            lower = F.replace(lower, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
        text = F.when(c.rlike(r"[\x00-\x1f]"), lower).otherwise(plain)
    return F.when(c.isNotNull(), text).otherwise("null")


@F.pandas_udf(T.StringType())
def normal_ip(values: pd.Series) -> pd.Series:
    """Addresses in canonical form; null where it is none. For ingest, where text of any spelling comes in."""
    known: dict[str, str | None] = {}

    def one(v):
        if not isinstance(v, str):
            return None
        if v not in known:
            try:
                known[v] = canonical_ip(v)
            except ValueError:
                known[v] = None
        return known[v]

    return values.map(one)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ip4_number(c: Column) -> Column:
    """A canonical IPv4 address as a number; null for anything else."""
    parts = F.split(c, r"\.")
    number = sum((parts[i].cast("bigint") * (1 << 24 - 8 * i) for i in range(1, 4)), parts[0].cast("bigint") * (1 << 24))
    return F.when(c.rlike(_V4), number)


def ip6_hex(c: Column) -> Column:
    """A canonical IPv6 address as 32 hex digits; null for anything else."""
    halves = F.split(c, "::")
    head = F.filter(F.split(halves[0], ":"), lambda x: x != "")
    tail = F.when(F.size(halves) > 1, F.filter(F.split(F.get(halves, F.lit(1)), ":"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)).cast("int"))
    text = F.array_join(F.transform(F.concat(head, zeros, tail), lambda x: F.lpad(x, 4, "0")), "")
    return F.when(c.contains(":") & c.rlike("^[0-9a-f:]+$") & (F.length(text) == 32), text)


def in_cidr(c: Column, block: str) -> Column:
    """Whether a canonical address is in a block of its own family; null only for null and what is no address of the family."""
    network = ipaddress.ip_network(block, strict=False)
    low, high = int(network.network_address), int(network.broadcast_address)
    if network.version == 4:
        size = network.prefixlen
        if size % 8 == 0 and size < 32:  # whole octets: a prefix test, which reaches the scan
            prefix = ".".join(str(network.network_address).split(".")[: size // 8])
            return c.startswith(prefix + ".") if size else c.contains(".") & ~c.contains(":")
        return ip4_number(c).between(low, high)
    return ip6_hex(c).between(f"{low:032x}", f"{high:032x}")
