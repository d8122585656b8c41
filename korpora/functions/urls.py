"""URL normalisation and related column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say nothing about the page.
TRACKING = r"(?:utm_[^=&]*|fbclid[^=&]*|gclid[^=&]*|mc_cid[^=&]*|mc_eid[^=&]*|ref)"
_ABSOLUTE = r"^(?i:https?)://[^/?#\s]+"


def _without_dots(path: Column) -> Column:
    """A path with its '.' and '..' steps taken."""
    steps = F.split(path, "/")
    taken = F.aggregate(
        F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(step == ".", done).otherwise(F.concat(done, F.array(step))),
    )
    end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(taken, end), "/"))).otherwise(path)


def normalize_url(url: Column) -> Column:
    """An absolute http(s) URL without fragment and tracking parameters, host in lower case; null for anything else.

    Dot steps of the path are taken; a path that is only '/' is dropped where no
    query follows.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(?:=|$)")), "&")
    origin = F.lower(F.regexp_extract(u, _ABSOLUTE, 0))
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(https?://)[^/@]*@", "$1"), r"^(http://[^/]+):80$|^(https://[^/]+):443$", "$1$2")
    path = _without_dots(F.regexp_replace(F.regexp_replace(u, _ABSOLUTE, ""), r"\?.*$", ""))
    full = F.concat(origin, F.when((path == "") & (kept != ""), "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(origin == "", None).otherwise(F.when((path == "/") & (kept == ""), origin).otherwise(full))


def resolve_url(raw: Column, base: Column) -> Column:
    """A possibly relative link against its page's normalised URL, normalised; null for other schemes and without a base."""
    r = F.trim(raw)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    full = (
        F.when(r.rlike(_ABSOLUTE), r).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(r.startswith("//"), F.concat(F.regexp_extract(base, "^https?:", 0), r))
        .when(r.startswith("/"), F.concat(F.regexp_extract(base, r"^https?://[^/?#]+", 0), r))
        .when((r == "") | r.startswith("#"), base).when(r.startswith("?"), F.concat(bare, r)).otherwise(F.concat(folder, r))
    )
    return normalize_url(full)


def domain(url: Column) -> Column:
    """Host of a URL in lower case, without port; null for anything that has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def of_site(host: Column, site: Column) -> Column:
    """Whether a host is the site or one of its subdomains."""
    return (host == site) | host.endswith(F.concat(F.lit("."), site))
