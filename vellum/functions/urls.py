"""Identity of web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only say where a reader came from (with every utm_*).
TRACKING = ("ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid")

#: Publications of one blogging site under hosts of their own.
PUBLICATIONS = ("infosecwriteups.com", "betterprogramming.pub", "levelup.gitconnected.com", "systemweakness.com", "osintteam.blog", "cybersecuritywriteups.com")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _rest(url: Column) -> Column:
    """Without scheme and fragment."""
    u = F.regexp_replace(_blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    return F.regexp_replace(u, "#.*$", "")


def host(url: Column) -> Column:
    """Lower-case host without ``www.``, user and port; empty for no url."""
    netloc = F.regexp_extract(_rest(url), r"^([^/?]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(_rest(url), r"^([^/?]*)", 1), r":(\d+)$", 1), F.lit(""))


def query_pairs(url: Column) -> Column:
    """The query's parameters that say what is read, sorted; spellings are kept as they are."""
    raw = F.split(F.regexp_extract(_rest(url), r"\?(.*)$", 1), "&")
    kept = F.filter(raw, lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    return F.array_sort(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))


def canonical_url(url: Column) -> Column:
    """One article, one key: no scheme, www., fragment, tracking parameters, default port or trailing slash; lower-case
    host; other parameters kept and sorted. Empty for no url."""
    where = F.regexp_extract(_rest(url), r"^[^/?]*([^?]*)", 1)
    p = port(url)
    netloc = F.when(p.isNotNull() & ~p.isin("80", "443"), F.concat(host(url), F.lit(":"), p)).otherwise(host(url))
    out = F.concat(netloc, F.rtrim(where, F.lit("/")))
    pairs = query_pairs(url)
    return F.when(host(url) == "", F.rtrim(_blank(url), F.lit("/"))).otherwise(F.when(F.size(pairs) > 0, F.concat(out, F.lit("?"), F.array_join(pairs, "&"))).otherwise(out))


def url_key(url: Column) -> Column:
    """The gate's key: query and fragment dropped, no trailing slash, lower-case scheme and host."""
    key = F.rtrim(F.substring_index(F.substring_index(_blank(url), "#", 1), "?", 1), F.lit("/"))
    front = F.regexp_extract(key, r"^(.*?://[^/]*)", 1)
    return F.concat(F.lower(front), F.substr(key, F.length(front) + 1))


def post_id(url: Column) -> Column:
    """The hexadecimal tail (8 to 16 digits) by which some blogs know a post; null without one."""
    path = F.substring_index(F.substring_index(_blank(url), "#", 1), "?", 1)
    return F.lower(F.nullif(F.regexp_extract(path, r"(?i)-([0-9a-f]{8,16})/?$", 1), F.lit("")))


def url_note_id(base: Column, url: Column) -> Column:
    """``base[:69]-sha1[:8]`` of the canonical url: an id that one article always gets."""
    cut = F.regexp_replace(F.substring(F.coalesce(base, F.lit("")), 1, 69), "-+$", "")
    return F.concat(F.when(cut == "", "note").otherwise(cut), F.lit("-"), F.substring(F.sha1(canonical_url(url).cast("binary")), 1, 8))


def id_family(note_id: Column) -> Column:
    return F.substring_index(F.coalesce(note_id, F.lit("")), "-", 1)


def blocked_host(host_col: Column) -> Column:
    """Why a host must not be fetched (loopback, private, link-local or local names), or null. Literal addresses only: what a
    name resolves to is the fetcher's to check."""
    h = F.lower(F.regexp_replace(F.trim(host_col), r"\.+$", ""))
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    private = rf"^(?:0|10|127)\.{octet}\.{octet}\.{octet}$|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|2[3-5]\d)\."
    return (
        F.when((h == "") | h.isNull(), "no host")
        .when((h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal") | h.endswith(".home.arpa"), "a local host name")
        .when(h.rlike(private) | h.rlike(r"^\[?(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$"), "a private, loopback or link-local address")
    )


def feed_url(url: Column) -> Column:
    """The feed that carries a post of a blogging site, or null: of its author, its publication or its own host."""
    h, path = host(url), F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    author, parts = F.nullif(F.regexp_extract(path, r"^/@([^/]+)/", 1), F.lit("")), F.filter(F.split(path, "/"), lambda p: p != "")
    base = F.lit("https://medium.com/feed/")
    return (
        F.when(h.endswith(".medium.com"), F.concat(base, F.lit("@"), F.regexp_replace(h, r"\.medium\.com$", "")))
        .when((h == "medium.com") & author.isNotNull(), F.concat(base, F.lit("@"), author))
        .when((h == "medium.com") & (F.size(parts) >= 2), F.concat(base, F.get(parts, F.lit(0))))
        .when(h.isin(*PUBLICATIONS), F.concat(F.lit("https://"), h, F.lit("/feed")))
    )
