"""Column expressions for addresses and host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions.text import contains_any, count_regex, ends_with_any


def octets(ip: Column) -> Column:
    """The four numbers, with -1 for a part that is no number."""
    return F.transform(F.split(ip, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def valid_octets(ip: Column) -> Column:
    return F.forall(octets(ip), lambda o: o.between(0, 255)) & (F.size(octets(ip)) == 4)


def _public(o: Column) -> Column:
    a, b, c, d = (F.get(o, i) for i in range(4))
    zeros = F.size(F.filter(o, lambda x: x == 0))
    reserved = (
        (zeros >= 2)
        | a.isin(10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | (a >= 224)
        | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a <= 3)
        | ((c == 1) & (d == 1))
        | ((c == 0) & d.isin(0, 1))
    )
    return ~reserved


def is_external_ip(ip: Column) -> Column:
    """A public address: valid octets, no leading zeros, no reserved range."""
    return valid_octets(ip) & ~ip.rlike(r"(^|\.)0[0-9]") & _public(octets(ip))


def ips_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.IP_WORD_RE), F.lit(0))


def contains_external_ip(text: Column) -> Column:
    return F.exists(ips_in(text), is_external_ip)


def is_suspicious_domain(url: Column) -> Column:
    host = F.substring_index(F.regexp_replace(url, r"^(https://)*(http://)*", ""), "/", 1)
    base = F.substring_index(host, ".", 1)
    n = F.octet_length(base)
    vowels = count_regex(base, "[aeiouAEIOU]")
    consonants = count_regex(base, "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]")
    odd = (
        (n >= 12)
        | ((n >= 8) & (vowels > 0) & (consonants >= 3 * vowels))
        | ((n >= 8) & base.rlike("[0-9]") & base.rlike("[A-Za-z]"))
        | ends_with_any(host, K.ODD_TLDS)
        | ((n >= 10) & contains_any(F.lower(base), K.ODD_CLUSTERS))
    )
    return ~ends_with_any(host, K.LEGITIMATE_DOMAINS) & odd
