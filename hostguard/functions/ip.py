"""IP address text as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address pattern, IPv4 first, then the IPv6 forms in this order.
IP_PATTERN = (
    r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)|"
    r"(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,7}:|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,6}:[A-Fa-f0-9]{1,4}|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,5}(?::[A-Fa-f0-9]{1,4}){1,2}|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,4}(?::[A-Fa-f0-9]{1,4}){1,3}|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,3}(?::[A-Fa-f0-9]{1,4}){1,4}|"
    r"(?:[A-Fa-f0-9]{1,4}:){1,2}(?::[A-Fa-f0-9]{1,4}){1,5}|"
    r"[A-Fa-f0-9]{1,4}:(?:(?::[A-Fa-f0-9]{1,4}){1,6})|"
    r":(?:(?::[A-Fa-f0-9]{1,4}){1,7}|:)"
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_V4_TAIL = rf":({_OCTET})\.({_OCTET})\.({_OCTET})\.({_OCTET})\z"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_V6_FULL = rf"^{_GROUP}(?::{_GROUP}){{7}}\z"
_V6_SHORT = rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_V4)


def _v6_groups_text(ip: Column) -> Column:
    """The address without its zone, a dotted tail written as two groups."""
    bare = F.regexp_replace(ip, r"%[^%/]+\z", "")
    octets = [F.regexp_extract(bare, _V4_TAIL, i).try_cast("int") for i in range(1, 5)]
    tail = F.concat_ws(
        ":",
        F.lower(F.hex((octets[0] * 256 + octets[1]).cast("bigint"))),
        F.lower(F.hex((octets[2] * 256 + octets[3]).cast("bigint"))),
    )
    return F.when(bare.rlike(_V4_TAIL), F.concat(F.regexp_replace(bare, _V4_TAIL, ":"), tail)).otherwise(bare)


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda part: part != "")


def is_ipv6(ip: Column) -> Column:
    return bind(
        _v6_groups_text(ip),
        lambda text: text.rlike(_V6_FULL) | (text.rlike(_V6_SHORT) & (F.size(_parts(text)) <= 7)),
    )


def is_ip(ip: Column) -> Column:
    return F.when(ip.rlike(r"^[0-9.]+\z"), is_ipv4(ip)).otherwise(is_ipv6(ip))


# Every address has one of these somewhere; one cheap scan spares most lines the ten forms above.
_MAYBE_IP = r"[0-9]\.[0-9]|[0-9A-Fa-f]:|::"


def first_ip(text: Column) -> Column:
    """The first address in ``text``. Only the first hit counts: if it is no valid address the result is null."""
    hit = F.when(text.rlike(_MAYBE_IP), F.regexp_extract(text, IP_PATTERN, 0))
    return bind(hit, lambda found: F.when((found != "") & is_ip(found), found))


def _v4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return reduce(lambda n, i: n * 256 + octets[i].cast("bigint"), range(1, 4), octets[0].cast("bigint"))


def _v4_network(ip: Column, prefix: int) -> Column:
    if prefix % 8 == 0 and prefix:
        # Whole octets: a valid address has no leading zeros, so its text can be cut as it is.
        kept = F.substring_index(ip, ".", prefix // 8)
        return F.concat(kept, F.lit(".0" * (4 - prefix // 8) + f"/{prefix}"))
    host_bits = 32 - prefix
    base = F.shiftleft(F.shiftright(_v4_number(ip), host_bits), host_bits)
    octets = [(F.shiftright(base, shift).bitwiseAND(F.lit(255))).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat(F.concat_ws(".", *octets), F.lit(f"/{prefix}"))


def _v6_groups(text: Column) -> Column:
    before = _parts(F.substring_index(text, "::", 1))
    after = F.when(text.contains("::"), _parts(F.substring_index(text, "::", -1))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.greatest(F.lit(8) - F.size(before) - F.size(after), F.lit(0))
    return F.concat(before, F.array_repeat(F.lit("0"), missing), after)


def _masked(groups: Column, prefix: int) -> Column:
    masks = F.array(*[F.lit((0xFFFF << (16 - min(max(prefix - 16 * i, 0), 16))) & 0xFFFF) for i in range(8)])
    return F.zip_with(
        groups,
        masks,
        lambda group, mask: F.lower(F.hex(F.conv(group, 16, 10).cast("bigint").bitwiseAND(mask))),
    )


def _shortened(joined: Column) -> Column:
    """Eight groups as text, the longest run of zero groups written as two colons."""
    shown = joined
    # Runs are tried from the shortest up, so the longest run wins as the outermost branch.
    for zeros in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{zeros - 1}}}(?:\z|:)(.*)\z"
        short = F.concat(F.regexp_extract(joined, run, 1), F.lit("::"), F.regexp_extract(joined, run, 2))
        shown = F.when(joined.rlike(run), short).otherwise(shown)
    return shown


def _v6_network(ip: Column, prefix: int) -> Column:
    groups = bind(_v6_groups_text(ip), _v6_groups)
    network = bind(F.concat_ws(":", _masked(groups, prefix)), _shortened)
    return F.concat(network, F.lit(f"/{prefix}"))


def subnet_of(ip: Column, prefix: int = 24) -> Column:
    """The network of ``ip`` with its host bits cleared, null for text that is no address."""
    v4 = _v4_network(ip, prefix) if prefix <= 32 else F.lit(None).cast("string")
    return F.when(is_ipv4(ip), v4).when(is_ip(ip), _v6_network(ip, prefix))
