"""Addresses against networks: sorted disjoint intervals, searched by bisection, or a join on common starts."""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import collapse_addresses, ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.hints import PRIVATE_NETWORKS, PRIVATE_STARTS

#: Leading hexadecimal digits by which addresses meet networks: 16 bits of IPv4, 32 of IPv6.
START_DIGITS = {4: 4, 6: 8}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def v4_number(ip: Column) -> Column:
    """The number of a dotted address, null if it is none."""
    valid = ip.rlike(r"\A(25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(25[0-5]|2[0-4]\d|[01]?\d?\d)){3}\z")
    part = lambda k: F.substring_index(F.substring_index(ip, ".", k), ".", -1).cast("long")
    return F.when(valid, part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4))


def v6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any spelling, a dotted end included; null if it is none."""
    plain_groups = r"\A([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\z"
    short_groups = r"\A([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?\z"
    padded = lambda text: F.array_join(F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")

    def spread(halves: Column) -> Column:
        return F.concat(halves["head"], F.repeat(F.lit("0"), F.lit(32) - F.length(halves["head"]) - F.length(halves["end"])), halves["end"])

    def digits(text: Column) -> Column:
        short = text.contains("::")
        valid = F.when(short, text.rlike(short_groups) & (F.regexp_count(text, F.lit("[0-9a-f]+")) < 8)).otherwise(text.rlike(plain_groups))
        head = padded(F.when(short, F.substring_index(text, "::", 1)).otherwise(text))
        end = padded(F.when(short, F.substring_index(text, "::", -1)).otherwise(""))
        return F.when(valid, let(F.struct(head.alias("head"), end.alias("end")), spread))

    def undotted(low: Column) -> Column:
        """Two groups instead of four decimal numbers at the end."""
        number = F.lpad(F.lower(F.hex(v4_number(F.regexp_extract(low, r"([^:]*)\z", 1)))), 8, "0")
        groups = let(number, lambda n: F.concat(F.substring(n, 1, 4), F.lit(":"), F.substring(n, 5, 4)))
        return F.when(low.contains("."), F.concat(F.regexp_replace(low, r"[^:]*\z", ""), groups)).otherwise(low)

    return let(undotted(F.lower(ip)), digits)


def within(value: Column, intervals: list[tuple]) -> Column:
    """Whether a value lies in one of some sorted disjoint intervals (first, last), by a tree of comparisons.

    Each row takes as many comparisons as the number of intervals has binary digits. The value is bound once, since
    the tree names it in every branch.
    """

    def tree(x: Column, part: list[tuple]) -> Column:
        if len(part) == 1:
            return (x >= part[0][0]) & (x <= part[0][1])
        half = len(part) // 2
        return F.when(x < part[half][0], tree(x, part[:half])).otherwise(tree(x, part[half:]))

    return let(value, lambda x: tree(x, intervals)) if intervals else F.lit(False)


def intervals_of(networks: tuple[str, ...]) -> list[tuple[int, int]]:
    """The first and last number of each network, overlapping and neighbouring ones made one."""
    return sorted((int(n[0]), int(n[-1])) for n in collapse_addresses(ip_network(n) for n in networks))


def is_private_address(column: Column | str) -> Column:
    """Private, loopback, link-local or reserved; what is no address counts as private, null is null.

    An IPv4 address mapped into IPv6, dotted or as two groups, counts as itself. Other IPv6 addresses go by how they
    begin as they are written.
    """
    low = F.lower(F.col(column) if isinstance(column, str) else column)
    rest = F.regexp_replace(low, r"\A::ffff:", "")
    is_pair = rest.rlike(r"\A[0-9a-f]{1,4}:[0-9a-f]{1,4}\z") & low.startswith("::ffff:")
    half = lambda k: F.conv(F.split_part(rest, F.lit(":"), F.lit(k)), 16, 10).cast("long")
    begins = F.lit(False)
    for start in PRIVATE_STARTS:
        begins = begins | low.startswith(start)
    dotted = ~low.contains(":") | (low.startswith("::ffff:") & rest.contains("."))
    number = F.when(dotted, v4_number(rest)).when(is_pair, half(1) * 65536 + half(2))
    private = F.coalesce(within(number, intervals_of(PRIVATE_NETWORKS)), F.lit(True))
    return F.when(dotted | is_pair, private).otherwise(low.isin("::", "::1") | begins)


def digits_of(ip: Column) -> Column:
    """struct<family, digits>: an address as hexadecimal digits of fixed length, which compare like its number."""
    return F.when(ip.contains(":"), F.struct(F.lit(6).alias("family"), v6_digits(ip).alias("digits"))).otherwise(
        F.struct(F.lit(4).alias("family"), F.lpad(F.lower(F.hex(v4_number(ip))), 8, "0").alias("digits"))
    )


def network_bounds(network: Column) -> Column:
    """struct<family, first, last>: the digits of the first and last address of a network such as 10.0.0.0/8."""
    bits = F.split_part(network, F.lit("/"), F.lit(2)).cast("int")

    def bounds(at: Column) -> Column:
        length, whole = F.when(at["family"] == 4, 8).otherwise(32), F.floor(at["bits"] / 4).cast("int")
        step = F.when(at["bits"] % 4 == 1, 8).when(at["bits"] % 4 == 2, 4).otherwise(2)
        cut = F.conv(F.substring(at["digits"], whole + 1, F.lit(1)), 16, 10).cast("int")
        edge = lambda digit, fill: F.rpad(F.concat(F.substring(at["digits"], F.lit(1), whole), F.when(at["bits"] % 4 > 0, F.lower(F.hex(digit))).otherwise("")), length, fill)
        return F.struct(at["family"].alias("family"), edge(cut - cut % step, "0").alias("first"), edge(cut - cut % step + step - 1, "f").alias("last"))

    return let(digits_of(F.split_part(network, F.lit("/"), F.lit(1))).withField("bits", bits), bounds)


def match_networks(addresses: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network") -> DataFrame:
    """Every address with each network of a table that holds it; addresses in none, and what is no address, are left out.

    Addresses and networks meet by their leading digits, four of IPv4 and eight of IPv6, or four where an IPv6 network is
    wider: a network stands under each start that it covers, which is one for most and 65,536 for a whole family. Spark's
    size check knows nothing of those copies, so the sides are sorted and merged, and neither is sent to the driver.
    """
    bounds = networks.select(network, network_bounds(F.col(network)).alias("b")).where("b.first is not null")
    short = F.when(F.col("b.family") == 4, START_DIGITS[4]).when(F.substring("b.first", 1, START_DIGITS[6]) == F.substring("b.last", 1, START_DIGITS[6]), START_DIGITS[6]).otherwise(4)
    number = lambda c: F.conv(F.substring(c, F.lit(1), short), 16, 10).cast("long")
    starts = bounds.select("*", short.alias("n"), F.explode(F.sequence(number(F.col("b.first")), number(F.col("b.last")))).alias("start"))
    named = addresses.withColumn("__at", digits_of(F.col(ip))).where("__at.digits is not null")
    keys = F.when(F.col("__at.family") == 4, F.array(F.lit(START_DIGITS[4]))).otherwise(F.array(F.lit(4), F.lit(START_DIGITS[6])))
    asked = named.withColumn("__n", F.explode(keys)).withColumn("__start", F.conv(F.substring(F.col("__at.digits"), F.lit(1), F.col("__n")), 16, 10).cast("long"))
    same = (asked["__at"]["family"] == starts["b"]["family"]) & (asked["__n"] == starts["n"]) & (asked["__start"] == starts["start"])
    found = asked.join(starts.hint("merge"), same & asked["__at"]["digits"].between(starts["b"]["first"], starts["b"]["last"]))
    return found.select(*addresses.columns, network)
