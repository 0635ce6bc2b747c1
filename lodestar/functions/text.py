"""Text as column expressions: tokens, normal forms, entropy, shingles, decay."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in questions.
STOPWORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "is", "are", "what", "how", "does", "do")


def fold(text: str) -> str:
    """Lower case without accents, in compatibility form where that is one character."""
    plain = "".join(_SINGLE.get(c, c) for c in text.lower())
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def _single() -> dict[str, str]:
    """Characters that stand for one other with accents or in another width, by the normal form NFKD."""
    out = {}
    for code in range(0xA0, 0x10000):
        if not 0xAC00 <= code < 0xE000:  # syllables keep their form, surrogates have none
            parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn"]
            if len(parts) == 1 and (low := parts[0].lower()) != chr(code) and len(low) == 1:
                out[chr(code)] = low
    return out


_SINGLE = _single()
_FROM, _TO = "".join(_SINGLE), "".join(_SINGLE.values())


def folded(x: Column) -> Column:
    """:func:`fold` as a column."""
    return F.regexp_replace(F.translate(F.lower(x), _FROM, _TO), r"\p{Mn}+", "")


def tokens(x: Column, blind: bool = False) -> Column:
    """Lower-case runs of letters and digits; ``blind`` to accents."""
    return F.filter(F.split(folded(x) if blind else F.lower(x), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def searchable(t: Column) -> Column:
    """Terms of a-z need more than two letters, all others pass."""
    return ~t.rlike("^[a-z]{1,2}$")


def norm_label(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", " "))


def shingles(x: Column, n: int = 3) -> Column:
    """Distinct n-grams of a string without its blanks; a shorter string is its only one."""
    s = F.replace(x, F.lit(" "), F.lit(""))
    return F.when(F.length(s) <= n, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(x, "")
    n = F.length(x)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda y: y == c)) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def html_to_text(html: Column) -> Column:
    """Scripts and styles go, tags become blanks, blanks collapse."""
    x = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, "(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, "[ \\t\\r\\n]+", " "))


def decay(age_days: Column, half_life: float) -> Column:
    """0.5 ** (age / half-life); the future counts as today, an unknown age as 1."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life), F.lit(1.0))


def norm_path(path: Column, root: str = "") -> Column:
    """Slashes forward, no leading ./, relative to ``root`` where it lies below it."""
    out = F.regexp_replace(F.regexp_replace(path, r"[\\\\]+", "/"), r"^(?:\./)+", "")
    base = root.rstrip("/") + "/"
    return F.when(out.startswith(base), F.substring(out, len(base) + 1, 1 << 30)).otherwise(out) if root else out


def path_stems(path: Column) -> Column:
    """All tails of a path without its suffix, as slugs, the longest first."""
    parts = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.regexp_replace(F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "_")), r"[^a-z0-9]+", "_"))


def parse_time(x: Column) -> Column:
    """An ISO time, UTC where it names no zone; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(x, r"Z$", "+00:00"))


#: What becomes of a page's tags, in order: (pattern, replacement).
MARKDOWN = (
    (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "),
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<h1[^>]*>", "\n\n# "),
    (r"(?is)<h2[^>]*>", "\n\n## "),
    (r"(?is)<h[3-6][^>]*>", "\n\n### "),
    (r"(?is)<li[^>]*>", "\n- "),
    (r"(?is)</?(?:strong|b)>", "**"),
    (r"(?is)</?(?:em|i)>", "*"),
    (r"(?is)</?code>", "`"),
    (r"(?is)<br[^>]*>", "\n"),
    (r"(?is)</(?:h[1-6]|p|div|ul|ol|table|tr|title)>", "\n\n"),
    (r"(?s)<[^>]+>", " "),
    (r"[ \t\r]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
)
LINK = r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"


def html_to_markdown(html: Column) -> Column:
    """Headings, lists, links, emphasis and code as Markdown; other tags become blanks, blanks and empty lines collapse."""
    x = F.regexp_replace(html, LINK, "[$2]($1)")
    for rx, to in MARKDOWN:
        x = F.regexp_replace(x, rx, to)
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def front_matter(url: Column, title: Column, kind: Column, body: Column) -> Column:
    """A document with a head of what it is and where it comes from; quotes in values are escaped."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\nsource_url: "), quoted(url), F.lit("\ntitle: "), quoted(title), F.lit("\ntype: "), kind, F.lit("\n---\n\n"), body)
