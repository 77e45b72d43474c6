"""URLs as columns: one spelling, hosts, shapes, segments, and names made from them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"
#: Latin letters with marks, made from their decompositions rather than listed.
_MARKED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
MARKED, PLAIN = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ORIGIN, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ORIGIN, 2))


def path(url: Column) -> Column:
    """The path, ``/`` where there is none."""
    found = F.regexp_extract(url, _ORIGIN, 3)
    return F.when(found == "", "/").otherwise(found)


#: A reference: scheme, authority, path, query and fragment, each with its sign or absent.
_REFERENCE = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(p: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments, by a fold that keeps a stack of segments."""
    parts = F.slice(F.split(p, "/", -1), 2, 1 << 30)
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def step(stack: Column, x: Column) -> Column:
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(x.rlike(two), up).when(x.rlike(one), stack).otherwise(F.array_append(stack, x))

    folder = F.when(p.rlike(r"(?i)/(\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step, lambda stack: F.concat(F.lit("/"), F.array_join(F.concat(stack, folder), "/")))
    return F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), folded).otherwise(p)


def resolve(href: Column, base: Column) -> Column:
    """``href`` as seen from the absolute url ``base``, dot segments removed.

    White space around it doesn't count, and ``\\`` before the query is read as ``/``. A reference with a scheme
    other than http and https stays as it is; null stays null, and so does what is relative to no http(s) base.
    """
    bare = F.regexp_replace(href, r"^[\s\x00-\x20]+|[\s\x00-\x20]+$", "")
    cut = F.regexp_extract(bare, r"(?s)^[^?#]*", 0)
    other = bare.rlike(r"^(?!(?i:https?):)[a-zA-Z][a-zA-Z0-9+.-]*:")
    read = F.concat(F.translate(cut, "\\", "/"), F.substr(bare, F.char_length(cut) + 1))
    part = lambda i: F.regexp_extract(read, _REFERENCE, i)
    own, authority, p, query, fragment = (part(i) for i in range(1, 6))
    near = scheme(base).isin("http", "https") & (host(base) != "")
    named = F.char_length(authority) > 2
    asked = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    before = F.when(named, F.concat(F.when(own == "", F.concat(scheme(base), F.lit(":"))).otherwise(F.lower(own)), authority)).otherwise(F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, _ORIGIN, 2)))
    merged = F.when(named & (p == ""), "/").when(named | p.startswith("/"), p).when(p != "", F.concat(F.regexp_extract(path(base), r"(?s)^.*/", 0), p)).otherwise(path(base))
    tail = F.when(~named & (p == "") & (query == ""), asked).otherwise(query)
    readable = F.when(named, (own != "") | near).otherwise((own == "") & near)
    return F.when(other, bare).when(readable, F.concat(before, without_dots(merged), tail, fragment))


def canonical(url: Column, host_alias: Column | None = None) -> Column:
    """One spelling of an absolute http(s) url: no query or fragment, scheme http, folded host, ``/`` after a directory.

    A path with a dot anywhere keeps its end as it is. Other schemes give null. ``host_alias``: the
    host that stands for this one, or null.
    """
    h = host(url) if host_alias is None else F.coalesce(host_alias, host(url))
    p = path(url)
    full = F.when(~p.contains(".") & ~p.endswith("/"), F.concat(p, F.lit("/"))).otherwise(p)
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.concat(F.lit("http://"), h, full))


def subdomain(host_col: Column, domain: str) -> Column:
    return F.replace(host_col, F.lit("." + domain), F.lit(""))


def is_internal(host_col: Column, domain: str) -> Column:
    return host_col.endswith(domain)


def last_part(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def is_page(url: Column, form: str = r"(^|/)contact-form(-\d+)?/") -> Column:
    """A directory or an html file, and not the mail form."""
    last = last_part(path(url))
    return ~path(url).rlike(form) & (~last.contains(".") | last.rlike(r"(?i)\.(html?|shtml)$"))


def is_document(url: Column) -> Column:
    return url.rlike(r"(?i)\.(pdf|docx?|rtf|zip)$")


def segments(url: Column) -> Column:
    """Path segments; an index file is its directory, other files lose their extension."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    last = F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1), F.lit(""))
    front = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    return F.when(~last.contains("."), parts).when(last.rlike(r"(?i)^(index|default)\."), front).otherwise(F.concat(front, F.array(F.regexp_replace(last, r"\.[^.]+$", ""))))


def parent(url: Column) -> Column:
    """The canonical url of the containing directory; null at the root."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    up = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(x, F.lit("/")))
    joined = F.concat(F.lit("/"), F.array_join(up, ""))
    return F.when(F.size(parts) > 0, F.concat(F.lit("http://"), host(url), joined))


def depth(url: Column) -> Column:
    return F.size(segments(url))


def is_file(url: Column) -> Column:
    return last_part(path(url)).contains(".")


def slugify(text: Column, most: int = 70) -> Column:
    """Lower-case words joined by ``-``: marks and quotes go, ``&`` is read out, at most ``most`` characters, else ``page``."""
    s = F.translate(text, MARKED, PLAIN)
    s = F.regexp_replace(s, "[̀-ͯ'‘’\"“”]", "")
    s = F.replace(F.lower(s), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("page"))


def file_name(url: Column) -> Column:
    """The last part of a url as a file name: decoded, its stem a slug, its extension lower case."""
    raw = F.coalesce(F.try_url_decode(F.replace(last_part(url), F.lit("+"), F.lit("%2B"))), last_part(url))
    dotted = raw.rlike(r"(?s)^.+\.")
    stem = F.when(dotted, F.regexp_replace(raw, r"\.[^.]*$", "")).otherwise(raw)
    return F.concat(slugify(stem), F.when(dotted, F.lower(F.regexp_extract(raw, r"(\.[^.]*)$", 1))).otherwise(""))


def media_key(url: Column, root: str = "news") -> Column:
    """Where a mirrored image is kept: year from ``/uploads/yyyy/``, slug, width from ``?w=``, extension or ``.jpg``."""
    year = F.coalesce(F.nullif(F.regexp_extract(url, r"/uploads/(\d{4})/", 1), F.lit("")), F.lit("undated"))
    last = last_part(path(url))
    ext = F.lower(F.regexp_extract(last, r"(\.[A-Za-z0-9]+)$", 1))
    width = F.regexp_extract(url, r"[?&]w=(\d+)", 1)
    return F.concat(F.lit(root + "/"), year, F.lit("/"), slugify(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")), F.when(width != "", F.concat(F.lit("-w"), width)).otherwise(""), F.when(ext == "", ".jpg").otherwise(ext))
