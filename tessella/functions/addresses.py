"""IP addresses as column expressions: their canonical form, and whether they are globally reachable."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The registries' special-purpose blocks that aren't globally reachable, and blocks in them that are.
LOCAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
REACHABLE = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: What an IPv6 address that stands for an IPv4 one begins with.
MAPPED = "0" * 20 + "ffff"


def local_ranges(version: int) -> list[tuple[str, str]]:
    """Sorted, disjoint (first, last) of the addresses that aren't reachable, as hexadecimal digits."""
    nets = [n for n in map(ipaddress.ip_network, LOCAL) if n.version == version]
    holes = sorted((int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, REACHABLE) if n.version == version)
    out = []
    for first, last in sorted((int(n[0]), int(n[-1])) for n in nets):
        for low, high in holes:
            if first <= low <= last:
                out.append((first, low - 1))
                first = high + 1
        out.append((first, last))
    digits = 8 if version == 4 else 32
    return [(f"{a:0{digits}x}", f"{b:0{digits}x}") for a, b in out if a <= b]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def ipv4_digits(text: Column) -> Column:
    """Eight hexadecimal digits of a dotted address; null if it is none."""

    def joined(octets: Column) -> Column:
        small = F.forall(octets, lambda o: F.try_to_number(o, F.lit("999")) < 256)
        return F.when(small, F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), ""))

    return F.when(text.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), let(F.split(text, r"\.", -1), joined))


def ipv6_digits(text: Column) -> Column:
    """Thirty-two hexadecimal digits of an IPv6 address in any of its forms; null if it is none."""

    def plain(tail: Column) -> Column:
        """The address with the dotted one that it may end with as two groups; null if that is none."""
        return F.when(tail == "", text).otherwise(let(ipv4_digits(tail), lambda four: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))))

    def groups(half: Column) -> Column:
        return F.when(half == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(half, ":", -1))

    def whole(parts: Column) -> Column:
        """parts: the groups before the double colon, those after it, and whether there is one."""
        given = F.size(parts["left"]) + F.size(parts["right"])
        full = F.concat(parts["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), parts["right"])
        fine = F.when(parts["halves"] == 2, given <= 7).otherwise((parts["halves"] == 1) & (given == 8))
        return let(full, lambda g: F.when(fine & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    def cut(halves: Column) -> Column:
        right = F.coalesce(groups(F.get(halves, 1)), F.expr("cast(array() as array<string>)"))
        return F.struct(groups(F.get(halves, 0)).alias("left"), right.alias("right"), F.size(halves).alias("halves"))

    tail = F.regexp_extract(text, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    return F.when(F.contains(text, F.lit(":")), let(let(F.split(F.lower(let(tail, plain)), "::", -1), cut), whole))


def digits(text: Column) -> Column:
    """The canonical form of an address: 8 hexadecimal digits of IPv4, 32 of IPv6; null if it is none."""
    return F.coalesce(ipv4_digits(text), ipv6_digits(text))


def reachable(canonical: Column) -> Column:
    """Whether an address in canonical form is globally reachable; one that stands for an IPv4 address, if that is."""

    def outside(bare: Column, version: int) -> Column:
        return ~reduce(lambda a, b: a | b, [bare.between(low, high) for low, high in local_ranges(version)])

    bare = F.when((F.length(canonical) == 32) & F.startswith(canonical, F.lit(MAPPED)), F.substring(canonical, 25, 8)).otherwise(canonical)
    return let(bare, lambda x: F.when(F.length(x) == 8, outside(x, 4)).when(F.length(x) == 32, outside(x, 6)))
