"""Addresses that names resolve to, against tables of address blocks.

An address is 128 bits, as 32 hexadecimal digits; version 4 addresses are the mapped
ones of version 6 (``::ffff:a.b.c.d``), so both forms of one are equal.  A block of
prefix length n holds an address if their first n bits are equal, so the join is by
(length, prefix) for the lengths that the blocks have, at most 129: an equi-join,
however many blocks there are and whether or not they nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import once

_HEX = "0123456789abcdef"
_V4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def _quad(ip: Column) -> Column:
    """Eight digits of a dotted address; null if a part is above 255."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    return F.when(ip.rlike(_V4), once(parts, lambda p: F.when(F.forall(p, lambda x: x.between(0, 255)), F.array_join(F.transform(p, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), ""))))


def ip_bits(ip: Column) -> Column:
    """32 hexadecimal digits of an address of either version, with or without ``::``,
    brackets, a zone or a dotted tail; null for anything else."""

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def digits(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda g: F.lpad(g, 4, "0")), "")

    def v6(t6: Column) -> Column:
        def told(x: Column) -> Column:
            left, right, sides = x["left"], x["right"], x["sides"]
            n, gap = F.size(left) + F.size(right), sides == 2
            sound = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~t6.rlike(":::|^:[^:]|[^:]:$") & (sides <= 2) & F.when(gap, n < 8).otherwise(n == 8)
            return F.when(sound, F.concat(digits(left), F.repeat(F.lit("0000"), 8 - n), digits(right)))

        return once(F.split(t6, "::"), lambda s: once(F.struct(groups(F.get(s, 0)).alias("left"), groups(F.get(s, 1)).alias("right"), F.size(s).alias("sides")), told))

    def told(t: Column) -> Column:
        dotted = once(_quad(F.regexp_extract(t, r":([0-9.]+)$", 1)), lambda q: F.when(q.isNotNull(), F.concat(F.regexp_replace(t, r"[0-9.]+$", ""), F.left(q, F.lit(4)), F.lit(":"), F.right(q, F.lit(4)))))
        six = once(F.when(~t.contains("."), t).otherwise(dotted), v6)
        return F.when(t.rlike("^[0-9a-f:.]+$"), F.coalesce(F.concat(F.lit("0" * 20 + "ffff"), _quad(t)), six))

    return once(F.regexp_replace(F.regexp_replace(F.lower(F.trim(ip)), r"^\[(.*)\]$", "$1"), "%.*$", ""), told)


def prefix(bits: Column, n: Column) -> Column:
    """The first ``n`` bits: whole digits, and a digit with its other bits cleared."""
    whole, step = F.floor(n / 4).cast("int"), F.pow(F.lit(2), 4 - n % 4).cast("int")
    digit = F.instr(F.lit(_HEX), F.substring(bits, whole + 1, F.lit(1))) - 1
    cut = F.substring(F.lit(_HEX), (F.floor(digit / step) * step + 1).cast("int"), F.lit(1))
    return F.concat(F.substring(bits, F.lit(1), whole), F.when(n % 4 == 0, "").otherwise(cut))


def blocks(cidrs: DataFrame, column: str = "block") -> DataFrame:
    """``cidrs`` with ``bits`` (the prefix length of 128) and ``prefix``; an address
    without a length is a block of one, rows that are no block are left out."""
    address, length = F.split(column, "/")[0], F.try_element_at(F.split(column, "/"), F.lit(2))
    most = F.when(address.contains(":"), 128).otherwise(32)
    n = F.when(length.isNull(), most).otherwise(length.try_cast("int"))
    rows = cidrs.withColumn("_a", ip_bits(address)).where(F.col("_a").isNotNull() & n.between(0, most))
    rows = rows.withColumn("bits", (n + 128 - most).cast("int"))
    return rows.withColumn("prefix", prefix(F.col("_a"), F.col("bits"))).drop("_a")


def covering(ips: DataFrame, cidrs: DataFrame, ip: str = "ip", column: str = "block") -> DataFrame:
    """(ip, block, blocks): for every different address that lies in a block the
    narrowest one and how many hold it."""
    held = blocks(cidrs.select(column).distinct(), column).groupBy("bits", "prefix").agg(F.min(column).alias("block"))
    lengths = [r.bits for r in held.select("bits").distinct().collect()]
    asked = ips.select(F.col(ip).alias("ip")).distinct().withColumn("_b", ip_bits(F.col("ip"))).where("_b is not null")
    asked = asked.withColumn("bits", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).withColumn("prefix", prefix(F.col("_b"), F.col("bits")))
    return asked.join(held, ["bits", "prefix"]).groupBy("ip").agg(F.max_by("block", "bits").alias("block"), F.count(F.lit(1)).alias("blocks"))


def reserved(spark) -> DataFrame:
    """The blocks that must not be fetched from."""
    return spark.createDataFrame([(b,) for b in C.RESERVED_BLOCKS], "block string")


def resolved(hosts: DataFrame, dns: DataFrame, cidrs: DataFrame | None = None) -> DataFrame:
    """(host, blocked, reason) of every different host, in lower case: blocked if one of
    its addresses in ``dns`` (host, ip) lies in a block, or if it has none.  A host that is
    an address stands for itself."""
    cidrs = reserved(hosts.sparkSession) if cidrs is None else cidrs
    asked = hosts.select(F.lower(F.trim("host")).alias("host")).where("host is not null").distinct()
    known = dns.select(F.lower(F.trim("host")).alias("host"), F.col("ip")).join(asked, "host", "left_semi")
    known = known.union(asked.where(ip_bits(F.col("host")).isNotNull()).select("host", F.col("host").alias("ip"))).where(ip_bits(F.col("ip")).isNotNull()).distinct()
    told = known.join(covering(known, cidrs), "ip", "left").groupBy("host").agg(F.min("block").alias("block"), F.count(F.lit(1)).alias("n"))
    out = asked.join(told, "host", "left")
    reason = F.when(F.col("n").isNull(), "unresolved").when(F.col("block").isNotNull(), F.concat(F.lit("in "), "block"))
    return out.select("host", reason.isNotNull().alias("blocked"), reason.alias("reason"))
