"""Strings: query segments and match expressions, formats of results, data URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import trim_unicode


def passes_gate(text: Column, least: int = 4) -> Column:
    return F.length(trim_unicode(F.coalesce(text, F.lit("")))) >= least


def segments(text: Column, least: int = 3, most: int = 16) -> Column:
    """array of struct(pos, segment): the longest segments between white space, the earlier first among equals."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    keyed = F.transform(parts, lambda s, i: F.struct((-F.length(s)).alias("k"), i.cast("long").alias("pos"), s.alias("segment")))
    long = F.filter(keyed, lambda x: x["k"] <= -least)
    return F.transform(F.slice(F.array_sort(long), 1, most), lambda x: F.struct(x["pos"].alias("pos"), x["segment"].alias("segment")))


def match_expression(text: Column, least: int = 3, most: int = 16) -> Column:
    """Quoted segments joined by OR; null where there are none."""
    quoted = F.transform(segments(text, least, most), lambda x: F.concat(F.lit('"'), F.replace(x["segment"], F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " OR "))


def host_name(header: Column) -> Column:
    """The host of a Host header: without brackets round it, or without its port."""
    end = F.instr(header, "]")
    inside = F.when(F.startswith(header, F.lit("[")) & (end > 0), F.substr(header, F.lit(2), end - 2))
    return F.coalesce(inside, F.regexp_replace(header, r"(?s):[^:]*$", ""))


def is_local(address: Column, header: Column) -> Column:
    """Whether a request comes from this machine: by its address (127.0.0.0/8, ::1, or the former mapped into IPv6), or by
    the name of the host that it asks for."""
    four = r"127\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    by_address = F.lower(address).rlike(rf"^({four}|::1|(0:){{7}}1|::ffff:{four}|::ffff:7f[0-9a-f]{{2}}:[0-9a-f]{{1,4}})$")
    return F.coalesce(by_address, F.lit(False)) | F.coalesce(F.lower(host_name(header)).isin("localhost", "127.0.0.1", "::1"), F.lit(False))


def data_uri_bytes(text: Column) -> Column:
    """Bytes of base64 text; what stands before the first comma, and that comma, are dropped. Null if it isn't base64."""
    return F.try_to_binary(F.trim(F.substr(text, F.instr(text, ",") + 1)), F.lit("base64"))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def human_bytes(n: Column) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("\u2013")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def percent(v: Column) -> Column:
    return F.concat(F.format_string("%.1f", v * 100), F.lit("%"))
