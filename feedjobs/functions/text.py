"""Text functions on columns. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_pattern(terms: Sequence[str]) -> str:
    """Regular expression for any of the terms, in any case, with no letter directly before or after."""
    return r"(?iu)(?<!\p{L})(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms) + r")(?!\p{L})"


def has_any(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike(word_pattern(terms)) if terms else F.lit(False)


#: Letters that patterns take for others than their lower case says, because both share an upper case.
_ODD = {c: c.upper().lower() for c in map(chr, range(0x80, 0x10000)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() != c}
_ODD = {c: x for c, x in _ODD.items() if len(x) == 1}


def _folded(term: str) -> str:
    """One spelling of all that a pattern without case takes for the same letters."""
    return term.replace("\u0130", "i").lower().translate(str.maketrans(_ODD))


def _folded_column(text: Column) -> Column:
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "".join(_ODD), "".join(_ODD.values()))


def _branches(tails: set[str]) -> str:
    """Regular expression for any of the tails, longer ones first wherever one begins another."""
    by_first: dict[str, set[str]] = {}
    for t in sorted(tails):
        if t:
            by_first.setdefault(t[0], set()).add(t[1:])
    escaped = lambda c: re.sub(r"([^\w\s])", r"\\\1", c)
    ways = [escaped(c) + _branches(rest) for c, rest in by_first.items()] + [""] * ("" in tails)
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def term_pattern(terms: Sequence[str]) -> str:
    """Regular expression that stops at every place where a term begins and captures the longest one there. It
    consumes nothing, so terms that overlap are all found, each at its own place. The terms form a tree of shared
    beginnings: a place costs as many steps as letters agree, however many terms there are."""
    return r"(?iu)(?<!\p{L})(?=(" + _branches({_folded(t) for t in terms}) + r")(?!\p{L}))"


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, in one scan of the text for all of them, in no order. What is captured at a place stands
    for the shorter terms that begin there too, which the captured term tells by itself."""
    if not terms:
        return F.array().cast("array<string>")
    implied: dict[str, list[str]] = {}
    for t in dict.fromkeys(terms):
        short = _folded(t)
        longer = [u for u in dict.fromkeys(terms) if _folded(u) == short or _folded(u).startswith(short) and not _folded(u)[len(short)].isalpha()]
        for u in longer:
            implied.setdefault(_folded(u), []).append(t)
    table = F.create_map(*[x for key, values in implied.items() for x in (F.lit(key), F.array(*[F.lit(v) for v in dict.fromkeys(values)]))])
    captured = F.array_distinct(F.regexp_extract_all(text, F.lit(term_pattern(terms)), F.lit(1)))
    each = F.transform(captured, lambda c: F.try_element_at(table, _folded_column(c)))
    return F.coalesce(F.array_distinct(F.flatten(F.array_compact(each))), F.array().cast("array<string>"))


def terms_among(found: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that `found_terms` of a longer list holds, in the order of `terms`."""
    if not terms:
        return F.array().cast("array<string>")
    listed = F.array(*[F.lit(t) for t in terms])
    return F.array_intersect(listed, found) if len(set(terms)) == len(terms) else F.filter(listed, lambda t: F.array_contains(found, t))


def any_among(found: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, in the order of `terms`."""
    return terms_among(found_terms(text, terms), terms)


def _character(code: Column) -> Column:
    """The character of a decimal code point; empty where there is none."""
    n = code.try_cast("bigint")
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def _decimal_entities(text: Column) -> Column:
    """`&#NNN;` replaced by their characters: the text between them and the characters are zipped."""
    codes = F.regexp_extract_all(text, F.lit("&#([0-9]+);"), F.lit(1))
    joined = F.array_join(F.zip_with(F.split(text, "&#[0-9]+;", -1), codes, lambda part, n: F.concat(part, F.when(n.isNull(), "").otherwise(_character(n)))), "")
    return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)


# Named entities, in the order in which they are replaced.
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    out = _decimal_entities(text)
    for name, plain in NAMED_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_html(text: Column) -> Column:
    """Plain text of a piece of a feed: CDATA unwrapped, entities decoded twice (feeds escape markup), then tags dropped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    plain = F.regexp_replace(decode_entities(decode_entities(plain)), "&nbsp;", " ")
    return squeeze(F.regexp_replace(plain, "<[^>]+>", " "))


def clean_page(text: Column) -> Column:
    """Plain text of a piece of a page: scripts, styles and tags dropped first, then entities decoded once."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    plain = F.replace(F.replace(F.regexp_replace(plain, "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&rsquo;"), F.lit("'"))
    return squeeze(decode_entities(plain))


def first_capture(text: Column, pattern: str) -> Column:
    """First group of the first match, or an empty string."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def tag_text(text: Column, name: str) -> Column:
    return clean_html(first_capture(text, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"))


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, footer and header."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|header)\b.*?</\1>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), "&nbsp;|&#160;", " "))


def norm_title(title: Column, length: int = 70) -> Column:
    """Title for comparison: lower case, without brackets and punctuation, cut."""
    plain = F.regexp_replace(F.lower(title), r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.left(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(length))


def event_key(title: Column, start: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""), F.date_format(start, "yyyy-MM"))


def item_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)
