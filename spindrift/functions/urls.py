"""URL normal form, scope rules and globs: as Columns for tables, as functions for single values."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote, unquote_plus, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, text

# Query parameters that only track.
TRACKING = (
    "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref_src", "igshid", "yclid", "_ga", "_gl",
    "dclid", "twclid", "si", "spm", "trk", "trkCampaign",
)
# Names are looked up in lower case, so the one camel-case entry never matches; kept as it is.
_TRACKS = frozenset(x for x in TRACKING if x == x.lower())

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


class UnsupportedUrl(ValueError):
    """A link that is never fetched."""


def is_tracking(key: str, keep: tuple[str, ...] = ()) -> bool:
    low = key.lower()
    if low in {k.lower() for k in keep}:
        return False
    return low in _TRACKS or (low.startswith("utm_") and len(low) > 4)


def _clean_path(path: str) -> str:
    path = re.sub("/+", "/", "/" + path)
    return path[:-1] if path.endswith("/") else path


def _resolve_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for p in parts:
        if p == "..":
            if out:
                out.pop()
        elif p != ".":
            out.append(p)
    if parts[-1] in (".", ".."):
        out.append("")
    return "/".join(out) if not out or out[0] == "" else "/" + "/".join(out)


def _reference(ref: str, base: str) -> tuple[str, str, str, str]:
    """(scheme, host, path, query) of a reference; dot segments go only when there is a base."""
    r = urlsplit(ref)
    if not base:
        return r.scheme, r.netloc, r.path, r.query
    b = urlsplit(base)
    if r.scheme:
        return r.scheme, r.netloc, _resolve_dots(r.path), r.query
    if r.netloc:
        return b.scheme, r.netloc, _resolve_dots(r.path), r.query
    if not r.path:
        return b.scheme, b.netloc, b.path, r.query or ("" if "?" in ref else b.query)
    whole = r.path if r.path.startswith("/") else b.path.rsplit("/", 1)[0] + "/" + r.path
    return b.scheme, b.netloc, _resolve_dots(whole), r.query


def normalize(raw: str, base: str = "", keep: tuple[str, ...] = ()) -> str:
    """Absolute URL without fragment and tracking, host in lower case, query sorted by key."""
    raw = (raw or "").strip()
    if not raw:
        raise UnsupportedUrl("empty URL")
    try:
        scheme = urlsplit(raw).scheme.lower()
        if scheme not in ("", "http", "https"):
            raise UnsupportedUrl(f"scheme {scheme!r} in {raw!r}")
        if not scheme and not base:
            raise UnsupportedUrl(f"{raw!r} is relative and there is no base")
        scheme, host, path, query = _reference(raw, base)
    except ValueError as e:
        raise UnsupportedUrl(str(e)) from e
    pairs: list[tuple[str, str]] = []
    for part in query.split("&"):
        if part and ";" not in part:
            k, _, v = part.partition("=")
            k = unquote_plus(k)
            if not is_tracking(k, keep):
                pairs.append((k, unquote_plus(v)))
    pairs.sort(key=lambda p: p[0])
    code = lambda s: quote(s, safe="-_.~").replace("%20", "+")
    tail = "?" + "&".join(f"{code(k)}={code(v)}" for k, v in pairs) if pairs else ""
    return f"{scheme.lower()}://{host.lower()}{quote(_clean_path(path), safe='/%:@!$&()*+,;=~-._' + chr(39))}{tail}"


def base_url(raw: str) -> str:
    """The base of a library: http(s), a host, a path that is not the root; no query, no fragment."""
    parts = urlsplit((raw or "").strip())
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
        raise UnsupportedUrl(f"{raw!r} is no http(s) URL")
    path = _clean_path(parts.path)
    if not path:
        raise UnsupportedUrl(f"{raw!r} has no path")
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{path}"


# ---------------------------------------------------------------- columns


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), _PARTS, 1))


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), _PARTS, 2))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(text(url), _PARTS, 3)


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/"), "/$", "")


def _escaped(c: Column, plain: str) -> Column:
    """The characters beside letters, digits and ``plain`` as percent escapes of their UTF-8 bytes."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for sign in (x for x in plain if x not in "-_."):
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out if "*" in plain else F.replace(out, F.lit("*"), F.lit("%2A"))


def normalized(url: Column | str) -> Column:
    """``normalize`` of absolute http(s) URLs; null for anything else."""
    u = F.trim(text(url))
    names = F.array(*[F.lit(x) for x in sorted(_TRACKS)])
    plain = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    parts = F.filter(F.split(F.regexp_extract(u, _PARTS, 4), "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    # By key, and in their own order within a key.
    pairs = F.transform(parts, lambda p, i: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), plain(value(p)).alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.array_contains(names, F.lower(p["k"])) | F.lower(p["k"]).rlike("^utm_.")))
    form = lambda c: F.replace(_escaped(c, "-_.~"), F.lit("%20"), F.lit("+"))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(form(p["k"]), F.lit("="), form(p["v"]))), "&")
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    path = _escaped(clean_path(path_of(u)), "/:@!$&()*+,;=~-._'%")
    return F.when(scheme_of(u).isin("http", "https"), F.concat(scheme_of(u), F.lit("://"), host_of(u), path, tail))


def under(path: Column, base: str) -> Column:
    """Equal to the base path or below it; /docs/latest does not hold /docs/latestness."""
    b = base.rstrip("/")
    return F.lit(True) if not b else (path == b) | path.startswith(b + "/")


def rule(pattern: str) -> str:
    """A scope rule with its leading slash; empty for a blank one."""
    p = (pattern or "").strip()
    return p if not p or p.startswith("/") else "/" + p


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob with *, **, ?, [] and {}; X/** holds X itself too."""

    def part(p: str) -> str:
        out, i = "", 0
        while i < len(p):
            c = p[i]
            if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif p.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and "]" in p[i + 2 :]:
                j = p.index("]", i + 2)
                out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1 if p[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", j + 1
            elif c == "{" and "}" in p[i:]:
                j = p.index("}", i)
                out, i = out + "(?:" + "|".join(part(x) for x in p[i + 1 : j].split(",")) + ")", j + 1
            else:
                out, i = out + re.escape(c), i + 1
        return out

    if pattern.endswith("/**"):
        return f"^{part(pattern[:-3])}(?:/.*)?$"
    return f"^{part(pattern)}$"


def in_scope(url: Column | str, base: str, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """Same scheme and host, below the base path, in some include if there are any, in no exclude."""
    parts = urlsplit(base)
    u = col(url)
    path = path_of(u)
    any_of = lambda rules: reduce(lambda a, b: a | b, [path.rlike(glob_regex(r)) for r in rules])
    ok = (scheme_of(u) == parts.scheme.lower()) & (host_of(u) == parts.netloc.lower()) & under(path, parts.path)
    if inc := [r for r in map(rule, includes) if r]:
        ok = ok & any_of(inc)
    if exc := [r for r in map(rule, excludes) if r]:
        ok = ok & ~any_of(exc)
    return ok


def is_document_type(content_type: Column | str) -> Column:
    kind = F.trim(F.lower(F.substring_index(text(content_type), ";", 1)))
    return kind.isin("", "text/html", "application/xhtml+xml")


def same_site(requested: Column | str, final: Column | str) -> Column:
    """Whether a redirect stayed on scheme and host."""
    return (scheme_of(requested) == scheme_of(final)) & (host_of(requested) == host_of(final))
