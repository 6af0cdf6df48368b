"""URL functions.  All are column expressions, so they stay inside codegen and
null in gives null out unless said otherwise.  Comparisons ignore case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A link that contains one of these is a file.
FILE_ENDINGS = [".doc", ".docx", ".pdf", ".png", ".jpg", ".jpeg", ".zip"]
HOME = "/"


def remove_trailing_slash(url: Column) -> Column:
    """Without one trailing slash."""
    return F.when(url.endswith("/"), F.substring(url, F.lit(1), F.length(url) - 1)).otherwise(url)


def same_link(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def relative_path(url: Column, site: Column, strict: bool = False) -> Column:
    """The url without the site: `/` for the site itself; null (an error where
    ``strict``) for a url of another site.  A trailing slash stays."""
    base = remove_trailing_slash(site)
    foreign = F.raise_error(F.concat(url, F.lit(" is not a page of "), site)) if strict else F.lit(None).cast("string")
    return (
        F.when(url.isNull() | site.isNull(), F.lit(None).cast("string"))
        .when(same_link(remove_trailing_slash(url), base), F.lit(HOME))
        .when(F.lower(url).startswith(F.lower(base)), F.substring(url, F.length(base) + 1, F.length(url)))
        .otherwise(foreign)
    )


def stored_path(path: Column) -> Column:
    """The key a page is stored by: without a trailing slash, but for the home page."""
    return F.when(path == HOME, path).otherwise(remove_trailing_slash(path))


def is_home_path(path: Column) -> Column:
    """False for null."""
    return path.eqNullSafe(HOME)


def is_file_link(link: Column) -> Column:
    low = F.lower(link)
    found = F.lit(False)
    for ending in FILE_ENDINGS:
        found = found | low.contains(ending)
    return found


def is_good_link(page: Column, link: Column, strict_boundary: bool = False) -> Column:
    """Whether a crawler on ``page`` follows ``link``: it goes down from the page,
    is not the page itself, has no `#` and is no file.  ``strict_boundary`` also
    asks that the link go on with `/` or `?` after the page's url."""
    page, link = remove_trailing_slash(page), remove_trailing_slash(link)
    good = F.lower(link).startswith(F.lower(page)) & ~same_link(page, link) & ~link.contains("#") & ~is_file_link(link)
    if strict_boundary:
        good = good & F.substring(link, F.length(page) + 1, F.lit(1)).isin("/", "?")
    return good


def page_in_site(site: Column, page: Column) -> Column:
    """Whether the page's url contains the site's with a slash after it."""
    return F.lower(page).contains(site_prefix(site))


def site_prefix(site: Column) -> Column:
    """What the urls of a site's pages contain, in lower case."""
    return F.lower(F.when(site.endswith("/"), site).otherwise(F.concat(site, F.lit("/"))))


def origin(url: Column) -> Column:
    """Scheme and host; empty where there is none."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def absolute_url(site: Column, path: Column) -> Column:
    return F.concat(site, path)


def _parts(reference: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Scheme with `:`, authority with `//`, path, query with `?`, fragment with `#`;
    each empty where it is missing."""
    pattern = r"(?s)^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    return tuple(F.coalesce(F.regexp_extract(reference, pattern, n), F.lit("")) for n in range(1, 6))


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments: a fold over the segments, in which
    `..` takes the last one away.  A path that doesn't begin with `/` stays."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == ".", kept).when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), none, step)
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference as an absolute url, by the algorithm of RFC 3986, section 5.2."""
    base_scheme, base_authority, base_path, base_query, _ = _parts(base)
    scheme, authority, path, query, fragment = _parts(reference)
    merged = F.when((base_authority != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path))
    return (
        F.when(scheme != "", F.concat(scheme, authority, without_dots(path), query, fragment))
        .when(authority != "", F.concat(base_scheme, authority, without_dots(path), query, fragment))
        .when(path == "", F.concat(base_scheme, base_authority, base_path, F.when(query != "", query).otherwise(base_query), fragment))
        .when(path.startswith("/"), F.concat(base_scheme, base_authority, without_dots(path), query, fragment))
        .otherwise(F.concat(base_scheme, base_authority, without_dots(merged), query, fragment))
    )


def resolve_href(base: Column, href: Column) -> Column:
    """A link's href as an absolute url; empty for mail, script and data links."""
    href = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    other = href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~href.rlike(r"(?i)^https?:")
    return F.when(other, F.lit("")).otherwise(resolve(base, href))
