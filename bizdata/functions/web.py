"""Columns over web addresses and HTML text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col, blank_to_null


def domain(c: Column | str) -> Column:
    """Host of a URL or e-mail address without scheme, `www.`, path or query."""
    v = F.lower(F.trim(as_col(c)))
    v = F.when(F.contains(v, F.lit("@")), F.split_part(v, F.lit("@"), F.lit(2))).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, r"^https?://", ""), r"^www\.", "")
    v = F.split_part(F.split_part(v, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
    return blank_to_null(F.trim(v))


def site_key(c: Column | str) -> Column:
    """Website spelling key used for duplicate groups: lower case, no scheme, no `www.`."""
    v = F.regexp_replace(F.lower(as_col(c)), r"^https?://", "")
    return F.regexp_replace(v, r"^www\.", "")


def candidate_urls(name: Column | str, location: Column | str) -> Column:
    """Web addresses a company of this name could own, NULL without a name; nothing is fetched."""
    stem = F.regexp_replace(F.lower(as_col(name)), rules.LEGAL_WORDS_IN_URLS, "")
    stem = F.regexp_replace(stem, r"[^a-z0-9]", "")
    where = F.lower(F.coalesce(as_col(location), F.lit("")))

    def has(*words: str) -> Column:
        return where.rlike("|".join(words))

    endings = F.array_compact(F.array(
        F.lit(".com"),
        F.when(has("uk", "united kingdom"), F.lit(".co.uk")),
        F.when(has("germany", "de"), F.lit(".de")),
        F.when(has("france", "fr"), F.lit(".fr")),
    ))
    with_www = F.transform(endings, lambda e: F.concat(F.lit("https://www."), stem, e))
    bare = F.transform(endings, lambda e: F.concat(F.lit("https://"), stem, e))
    return F.when(as_col(name).isNotNull(), F.concat(with_www, bare))


def blocked_host(url: Column | str) -> Column:
    """Social networks, registries and encyclopedias are never a company's own site."""
    host = domain(url)
    return F.exists(F.array(*[F.lit(h) for h in rules.BLOCKED_HOSTS]), lambda h: F.contains(host, h))


def likely_site(url: Column | str, name: Column | str) -> Column:
    """Some word of the name (3+ letters) occurs in the host."""
    host = F.coalesce(domain(url), F.lit(""))
    words = F.split(F.regexp_replace(F.lower(as_col(name)), r"[^a-z0-9]+", " "), " ")
    return F.exists(words, lambda w: (F.length(w) > 2) & F.contains(host, w))


def profile_url(c: Column | str) -> Column:
    v = F.replace(F.lower(as_col(c)), F.lit("http://"), F.lit("https://"))
    return F.replace(v, F.lit("www."), F.lit(""))


# --- HTML -------------------------------------------------------------------------------------

def _drop_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def _unescape(c: Column) -> Column:
    for entity, char in rules.HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_text(c: Column | str) -> Column:
    """Visible text of a page in lower case.  The whole page is read, no cut-off."""
    v = F.regexp_replace(as_col(c), r"(?is)<script[^>]*>.*?</script>", "")
    v = F.regexp_replace(v, r"(?is)<style[^>]*>.*?</style>", "")
    v = F.regexp_replace(F.regexp_replace(v, r"<[^>]+>", " "), r"\s+", " ")
    return F.lower(v)


def visible_text(c: Column | str) -> Column:
    """As html_text, but the letter case is kept (names need it)."""
    v = F.regexp_replace(as_col(c), r"(?is)<script[^>]*>.*?</script>", "")
    v = F.regexp_replace(v, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(F.regexp_replace(v, r"<[^>]+>", " "), r"\s+", " ")


def _element(html: Column, tag: str) -> Column:
    body = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return blank_to_null(_unescape(_drop_tags(body)))


def _meta(html: Column, attribute: str, value: str) -> Column:
    content = F.regexp_extract(
        html, rf"""(?is)<meta\s[^>]*{attribute}=["']{value}["'][^>]*content=["']([^"']*)["']""", 1)
    return blank_to_null(_unescape(F.trim(content)))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(as_col(html), F.lit(r"""(?is)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))


def links(html: Column | str) -> Column:
    """Array of (href, text) for every anchor, in page order."""
    pattern = F.lit(r"""(?is)<a\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""")
    html = as_col(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"),
        F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"),
    )
    return F.transform(pairs, lambda p: F.struct(
        p["href"].alias("href"), _unescape(_drop_tags(p["text"])).alias("text")))


def html_fields(html: Column | str) -> Column:
    html = as_col(html)
    targets = hrefs(html)

    def of_kind(scheme: str) -> Column:
        return F.transform(
            F.filter(targets, lambda h: F.startswith(F.lower(h), F.lit(scheme))),
            lambda h: F.split_part(F.substr(h, F.lit(len(scheme) + 1)), F.lit("?"), F.lit(1)))

    return F.struct(
        _element(html, "title").alias("title"),
        _meta(html, "name", "description").alias("description"),
        _meta(html, "property", "og:site_name").alias("site_name"),
        _element(html, "h1").alias("h1"),
        _element(html, "footer").alias("footer"),
        F.size(targets).alias("n_links"),
        of_kind("tel:").alias("tels"),
        of_kind("mailto:").alias("mailtos"),
    )


def social_links(html: Column | str) -> Column:
    """First link to each network."""
    targets = hrefs(html)

    def first_with(*parts: str) -> Column:
        hit = F.filter(targets, lambda h: h.rlike("|".join(p.replace(".", r"\.") for p in parts)))
        return F.get(hit, F.lit(0))

    return F.struct(
        first_with("linkedin.com").alias("linkedin"),
        first_with("twitter.com", "x.com").alias("twitter"),
        first_with("facebook.com").alias("facebook"),
        first_with("instagram.com").alias("instagram"),
    )


def social_profiles(html: Column | str) -> Column:
    """First profile-shaped address of each network that is not on the skip list."""
    html = as_col(html)

    def first_profile(pattern: str) -> Column:
        hits = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
        good = F.filter(hits, lambda h: ~F.exists(
            F.array(*[F.lit(s) for s in rules.SKIP_PROFILES]), lambda s: F.contains(F.lower(h), s)))
        return F.split_part(F.regexp_replace(F.get(good, F.lit(0)), r"/$", ""), F.lit("?"), F.lit(1))

    return F.struct(*[first_profile(p).alias(net) for net, p in rules.PROFILE_PATTERNS])


def contact_link(page_links: Column | str) -> Column:
    """First link whose text or target speaks of contact."""
    hit = F.filter(as_col(page_links), lambda link: link["text"].rlike(rules.CONTACT_LINK)
                   | link["href"].rlike(rules.CONTACT_LINK))
    return F.get(hit, F.lit(0))["href"]
