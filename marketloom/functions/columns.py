"""Column helpers that operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once: later uses refer to them, where a plain new column is written out again in each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def rounded(x: Column, places: int = 0) -> Column:
    """Half-up rounding, as scores are rounded everywhere here."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def number(x: Column) -> Column:
    """Text as a finite double; blank, not a number and infinite are null."""
    value = F.nullif(F.trim(x), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clean_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s ﻿]+", " "))


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s{2,}|[\t\n\x0B\f\r]", " "))  # a single space is one already


def holds_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def matches(text: Column, pattern: str, words: Iterable[str] | None = None, low: Column | None = None) -> Column:
    """text.rlike(pattern), where words are looked for first: each match must hold one of them (in low, the lower-cased text, if given).

    A pattern of plain words alone needs none told, and no search by pattern: at each letter of a text that tries them one after the other.
    """
    if words is not None:
        return holds_any(text if low is None else low, words) & text.rlike(pattern)
    return text.rlike(pattern) if re.search(r"[\\^$.\[\](){}*+?]", pattern) else holds_any(text, pattern.split("|"))


def tag_text(html: Column, tag: str) -> Column:
    """Visible text of the first such tag, or ''."""
    return visible_text(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def site_id(url: Column) -> Column:
    """Host without a leading www, m or blog."""
    return F.regexp_replace(url_host(url), r"^(www|m|blog)\.", "")


def canonical_url(url: Column) -> Column:
    """Without query, fragment and a closing slash."""
    path = url_path(url)
    return F.concat(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path))


# Page types in the order in which they are tried, and the path patterns of each.
PAGE_TYPES = [
    ("homepage", r"^/$|^/home/?$"),
    ("products", r"/products?\b|/shop\b|/collections?\b|/catalog\b"),
    ("services", r"/services?\b"),
    ("pricing", r"/pricing\b|/plans?\b"),
    ("about", r"/about\b|/our-story\b|/story\b"),
    ("contact", r"/contact\b|/support\b"),
    ("reviews", r"/reviews?\b|/testimonials?\b"),
    ("faq", r"/faq\b|/help\b"),
    ("shipping", r"/shipping\b|/delivery\b"),
    ("returns", r"/returns?\b|/refunds?\b"),
    ("privacy", r"/privacy\b"),
    ("terms", r"/terms\b|/tos\b"),
    ("blog", r"/blog\b|/articles?\b|/news\b"),
]
# Paths that aren't crawled.
BLOCKED = r"/logout\b|/cart\b|/checkout\b|/account\b|/admin\b|/wp-admin\b|/my-account\b|/signin\b|/sign-in\b|/login\b|/tracking\b|/track\b|/pixel\b|/collect\b|/beacon\b|/gtm\b|/analytics\b"


def page_type(url: Column, path: Column | None = None) -> Column:
    """The first type whose pattern the path (of the url, if not given) has."""
    path = F.lower(url_path(url) if path is None else path)
    out = F.when(url_host(url) == "", F.lit("unknown"))
    for name, pattern in PAGE_TYPES:
        out = out.when(path.rlike(pattern), F.lit(name))
    return out.otherwise("page")


def url_priority(url: Column, path: Column | None = None) -> Column:
    """Place of the page type, 50 for all others; the type is tested once."""
    places = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(PAGE_TYPES) for x in (name, k)))
    return F.coalesce(F.element_at(places, page_type(url, path)), F.lit(50))


def blocked(url: Column, path: Column | None = None) -> Column:
    return F.lower(url_path(url) if path is None else path).rlike(BLOCKED)


def folded_dots(url: Column) -> Column:
    """An absolute URL whose path has no `.` and `..` segments."""
    root, path, rest = (F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)([^?#]*)(.*)$", k) for k in (1, 2, 3))

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    open_end = F.element_at(parts, -1).isin(".", "..")
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.concat(root, folded, F.when(open_end, "/").otherwise(""), rest)).otherwise(url)


def strength(count: Column, weak: int, medium: int, strong: int) -> Column:
    """0 none, 1 weak, 2 medium, 3 strong."""
    return F.when(count >= strong, 3).when(count >= medium, 2).when(count >= weak, 1).otherwise(0)


def points(code: Column, most: float) -> Column:
    """Points of a strength: a third, two thirds, or all."""
    return rounded(most * F.when(code == 3, 1.0).when(code == 2, 0.66).when(code == 1, 0.33).otherwise(0.0))
