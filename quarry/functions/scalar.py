"""Scalar functions on columns: text, URLs, numbers, cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's `str.split` knows it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """The text without white space at its ends, as Python's `str.strip` knows it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def norm(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def word_count(text: Column) -> Column:
    """Words at white space; 0 for an empty text."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def space_pieces(text: Column) -> Column:
    """Pieces at single spaces, empty ones included (not the same as words)."""
    return F.size(F.split(text, " ", -1))


def truthy(text: Column) -> Column:
    """The text, or null where it is empty: what `x or default` looks at."""
    return F.nullif(text, F.lit(""))


def abridge(text: Column, n: int) -> Column:
    """The first n words, marked where more follow."""
    ws = F.filter(F.split(text, SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(ws, 1, n), " ")
    return F.when(F.size(ws) > n, F.concat(cut, F.lit(" …"))).otherwise(cut)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_host(url: Column) -> Column:
    """Lower-case host without user or port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_key(url: Column) -> Column:
    """Host and path without scheme, fragment and closing slash; the query stays."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.concat(authority, F.regexp_replace(path, r"/+$", ""), query)


def in_domains(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith("." + d)
    return found


def worst_severity(*verdicts: Column) -> Column:
    """The worst of PASS < MINOR_REVISION < REJECT; nulls do not count."""
    names = ["PASS", "MINOR_REVISION", "REJECT"]
    level = F.greatest(*[F.nullif(F.array_position(F.lit(names), v), F.lit(0)) for v in verdicts])
    return F.get(F.lit(names), (level - 1).cast("int"))


def smoothed_weight(failed: Column, size: Column, total: Column) -> Column:
    """Beta(1,1)-smoothed failure rate times the unused share, floored at 1e-9."""
    share = F.when(total > 0, size / total).otherwise(F.lit(0.0))
    return F.greatest((failed + 1) / (size + 2) * (1 - share), F.lit(1e-9))


def token_cost(usage: dict[str, Column], rate_in: Column, rate_out: Column) -> Column:
    """USD for token counts at rates per million; cache writes cost 1.25, reads 0.10 of input."""
    def n(k: str) -> Column:
        return F.coalesce(usage[k], F.lit(0)) if k in usage else F.lit(0)

    cost = n("input") * rate_in + n("output") * rate_out
    return (cost + n("cache_write") * rate_in * 1.25 + n("cache_read") * rate_in * 0.10) / 1e6


def unit_hash(salt: str, key: Column) -> Column:
    """A uniform number in (0, 1) from md5, the same in every engine, run and partitioning."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, summed in index order; 1.0 where a vector is zero."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(1 - dot(a, b) / (na * nb))
