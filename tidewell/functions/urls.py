"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that tell how a page was reached (fixed values); utm_ as a prefix.
TRACKING = ["spm", "from", "pvid", "share_from", "scene"]
_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def normalized_url(url: Column) -> Column:
    """Lower scheme and host, no fragment, no tracking parameters, the others in their order.

    What is no URL is cut at its first '#'. Null stays null.
    """
    part = lambda k: F.regexp_extract(url, _URL, k)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))
    query = F.array_join(kept, "&")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_URL), whole).otherwise(F.substring_index(url, "#", 1))


def host_of(url: Column, fallback: Column | None = None, default: str | None = "", keep_port: bool = True) -> Column:
    """Host of a URL in lower case without a leading www.; else the fallback in lower case; else the default."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    if not keep_port:
        host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":\\d+$", "")
    tries = [F.when(host != "", host)]
    if fallback is not None:
        tries.append(F.when(F.trim(fallback) != "", F.lower(F.trim(fallback))))
    found = F.regexp_replace(F.coalesce(*tries, F.lit(default)), "^www\\.", "")
    return found


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))) if domains else F.lit(False)
