"""URL functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that start so (whatever their case) are tracking parameters.
TRACKING_PREFIXES = ("utm_", "ga_", "yclid", "fbclid", "gclid", "mc_cid", "mc_eid", "vero_", "_ga", "ref", "ref_src", "ref_url", "spm", "share_source", "from", "src")

#: Category ids and their aliases, in order.
CATEGORY_ALIASES = {
    "thoi_su": ("thời sự", "thoi-su", "xa-hoi", "xã hội"),
    "kinh_doanh": ("kinh doanh", "kinh-doanh", "kinh-te", "kinh tế"),
    "cong_nghe": ("công nghệ", "cong-nghe", "so-hoa", "khoa-hoc"),
    "the_thao": ("thể thao", "the-thao"),
    "giai_tri": ("giải trí", "giai-tri", "van-hoa-giai-tri"),
    "giao_duc": ("giáo dục", "giao-duc", "giao-duc-huong-nghiep"),
    "suc_khoe": ("sức khỏe", "suc-khoe"),
    "the_gioi": ("thế giới", "the-gioi"),
}

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    hit = F.lit(False)
    for prefix in TRACKING_PREFIXES:
        hit = hit | low.startswith(prefix)
    return hit


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of the decoded pairs with a value, in order; a malformed escape stays as it is."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    split = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    pair = F.transform(split, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    return F.filter(pair, lambda p: p["v"] != "")


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """The URL that stands for all spellings of it; null and empty stay as they are.

    Scheme (https if none) and host are lower-cased, a default port and the fragment go,
    tracking and blank parameters go and the rest are sorted, double slashes in the path
    become one and one at its end goes.  ``www.`` and http are told apart from their
    counterparts.
    """
    scheme = F.when(_part(url, 1) == "", F.lit("https")).otherwise(F.lower(_part(url, 1)))
    host = F.lower(_part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(_part(url, 3), r"/{2,}", "/")
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path)
    kept = F.array_sort(F.filter(query_pairs(_part(url, 4)), lambda p: ~is_tracking(p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNull() | (url == ""), url).otherwise(whole)


def url_hash(url: Column) -> Column:
    return F.substr(F.sha2(canonical_url(url), 256), F.lit(1), F.lit(32))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))


def url_category(url: Column) -> Column:
    """The first path segment that another one follows, lower-cased, ``-`` as ``_``; null if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?//[^/]*/(?:/?)([\p{L}\p{N}_\-]+)/", 1)
    return F.nullif(F.lower(F.replace(found, F.lit("-"), F.lit("_"))), F.lit(""))


def canonical_category(raw: Column, aliases: dict[str, tuple[str, ...]] = CATEGORY_ALIASES) -> Column:
    """The first category, in order, with an alias that holds ``raw`` or is held by it; null if none."""
    needle = F.lower(raw)
    either = lambda a: F.contains(needle, F.lit(a)) | F.contains(F.lit(a), needle)
    found = F.lit(None).cast("string")
    for name, words in reversed(aliases.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | either(word.lower())
        found = F.when(hit, F.lit(name)).otherwise(found)
    return F.when(raw.isNotNull() & (raw != ""), found)
