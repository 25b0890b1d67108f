"""Small text and byte functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accepted(header: Column) -> Column:
    """Media types of an Accept header in order: parameters and blanks off, empty parts skipped."""
    parts = F.transform(F.split(header, ","), lambda x: F.btrim(F.element_at(F.split(x, ";"), 1), F.lit(" \t")))
    return F.filter(parts, lambda x: x != "")


def media_match(pattern: Column, media: Column) -> Column:
    whole = pattern == "*/*"
    kind = pattern.endswith("/*") & F.startswith(media, F.regexp_replace(pattern, r"\*$", ""))
    return whole | kind | (pattern == media)


def negotiate(header: Column, supported: list[str]) -> Column:
    """The first supported type, in order of acceptance, then of support; null for none."""
    every = F.flatten(F.transform(accepted(header), lambda a: F.filter(F.array(*map(F.lit, supported)), lambda s: media_match(a, s))))
    return F.get(every, F.lit(0))


def percent_encode(text: Column) -> Column:
    """All but letters, digits and ``-_.~`` as %XX of the UTF-8 bytes."""
    e = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def canonical_query(pairs: Column) -> Column:
    """``k=v`` pairs sorted by raw name, encoded, joined by &."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(percent_encode(p.k), F.lit("="), percent_encode(p.v))), "&")


def host(address: Column) -> Column:
    return F.substring_index(address, ":", 1)


def port(address: Column) -> Column:
    return F.substring_index(address, ":", -1).try_cast("int")


def nonempty_parts(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda x: x != "")


def block_size_valid(n: Column) -> Column:
    return n.between(16, 1024) & (n.bitwiseAND(n - 1) == 0)


def szx(size: Column) -> Column:
    return (F.log2(size) - 4).cast("int")


def szx_size(n: Column) -> Column:
    return F.pow(F.lit(2), n + 4).cast("int")


def multicast_address(address: Column) -> Column:
    """Three dots exactly and a first part of 224 to 239; the other parts aren't looked at."""
    parts = F.split(address, r"\.")
    first = F.element_at(parts, 1).try_cast("int")
    return (F.size(parts) == 4) & F.coalesce(first.between(224, 239), F.lit(False))


def tls_range_valid(low: Column, high: Column) -> Column:
    """Versions as text, empty for the default: at least 1.2 and in order."""
    def ordinal(v, default):
        return F.when(v == "", default).when(v == "TLSv1.2", 2).when(v == "TLSv1.3", 3).otherwise(-1)

    a, b = ordinal(low, 2), ordinal(high, 3)
    return (a > 0) & (b > 0) & (a <= b)


def certificate_state(not_before: Column, not_after: Column, now: Column) -> Column:
    return F.when(now < not_before, "not_yet_valid").when(now > not_after, "expired").when(not_after <= now + F.expr("INTERVAL 30 DAYS"), "expires_soon").otherwise("valid")


def frame_length(frame: Column) -> Column:
    """Length in a frame's first four bytes (big-endian); null for none, 0 or over 64 MiB."""
    n = F.conv(F.hex(F.substring(frame, 1, 4)), 16, 10).cast("long")
    return F.when((F.length(frame) >= 4) & n.between(1, 64 << 20), n)


def message_type(json: Column) -> Column:
    return F.get_json_object(json, "$.type")


def node_number(node: Column) -> Column:
    """A node's id as a number: its digits, or a hash of its text."""
    return F.coalesce(node.try_cast("long"), F.xxhash64(node).bitwiseAND((1 << 63) - 1))
