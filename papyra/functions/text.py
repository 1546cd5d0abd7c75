"""Column builders for document text: hashing, cleaning, contact extraction,
resume classification and HTML-to-text.  All native Spark expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import lexicons as L
from papyra.functions.regex import java_regex


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- D1 -----------------------------------------------------------------------
def content_hash(col) -> Column:
    """md5 hex digest of the UTF-8 bytes of the raw (uncleaned) text."""
    return F.md5(_c(col))


# -- D2 -----------------------------------------------------------------------
_ESCAPED_UNICODE = java_regex(r"\\u\w{4}")
_WHITESPACE_RUN = java_regex(r"\s+")


def _unless_contains(c: Column, needle: str, expr: Column, otherwise: Column) -> Column:
    """``expr`` only where ``needle`` occurs (a necessary condition for a match)."""
    return F.when(~c.contains(needle), otherwise).otherwise(expr)


def clean_text(col) -> Column:
    """Literal backslash-u + 4 word chars -> space, whitespace runs -> one space, trim."""
    c = _c(col)
    c = _unless_contains(c, "\\u", F.regexp_replace(c, _ESCAPED_UNICODE, " "), c)
    c = F.regexp_replace(c, _WHITESPACE_RUN, " ")
    return F.trim(c)


# -- D3 -----------------------------------------------------------------------
def clean_html_text(col, steps=None) -> Column:
    """Markup/CSS stripper: the fixed substitution chain, then trim."""
    c = _c(col)
    for pattern, repl in (steps or L.HTML_CLEAN_STEPS):
        c = F.regexp_replace(c, java_regex(pattern), repl)
    return F.trim(c)


# -- D4 -----------------------------------------------------------------------
_HTML_DROP = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>"
# A tag opens with a letter, "/", "!" or "?"; a ">" inside a quoted value doesn't close it.
_HTML_TAG = r"""(?s)<[a-zA-Z/!?][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|<[a-zA-Z/!?][^>]*>"""
# Python str.splitlines() boundaries.
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_EDGE_SPACE = java_regex(r"^\s+|\s+$")


def html_to_text(col) -> Column:
    """Visible text of an HTML page: one text node per line, lines trimmed, blanks dropped.

    Comments, doctype, script and style bodies are removed first (scripts may
    contain tag-like strings), then every tag becomes a line break, then
    character references are decoded, once each.
    """
    c = F.regexp_replace(_c(col), _HTML_DROP, "\n")
    c = decode_entities(F.regexp_replace(c, _HTML_TAG, "\n"))
    lines = F.transform(F.split(c, _LINE_BREAK), lambda x: F.regexp_replace(x, _EDGE_SPACE, ""))
    return F.array_join(F.filter(lines, lambda x: x != F.lit("")), "\n")


_REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[a-zA-Z][a-zA-Z0-9]{0,31};?)"
# The standard's table, from the Python library; names without ";" may end anywhere, the longest one counts.
_NAMED = {f"&{name}": char for name, char in html5.items()}
_OPEN_NAME = "^(?:" + "|".join(sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)) + ")"
# Numbers 128 to 159 stand for windows-1252 characters where that has one.
_WINDOWS = {i: c for i in range(128, 160) if (c := bytes([i]).decode("cp1252", "ignore"))}


def _code_point_char(cp: Column) -> Column:
    """One character for a code point (U+FFFD when not a valid scalar value)."""
    valid = (cp >= 1) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    windows = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    return (F.when(cp.between(128, 159), F.coalesce(F.try_element_at(windows, cp.cast("int")), ch))
            .when(valid, ch).otherwise(F.lit("\ufffd")))


def decode_entities(col) -> Column:
    """Named and numeric character references -> characters, natively, each decoded once.

    Unknown names stay as they are; a missing ";" is accepted after numbers and after the names
    that the standard allows without it.
    """
    c = _c(col)
    # a literal map is searched from its front: short names are the common ones
    table = "\x02".join(f"{name}\x01{char}" for name, char in sorted(_NAMED.items(), key=lambda x: len(x[0])))
    named = F.str_to_map(F.lit(table), F.lit("\x02"), F.lit("\x01"))                 # folded to one literal

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+)", 1))
        head = F.regexp_extract(x, _OPEN_NAME, 0)
        open_name = F.concat(F.try_element_at(named, head), F.substr(x, F.length(head) + 1))
        return F.when(x.startswith("&#"), _code_point_char(number.try_cast("long"))).otherwise(
            F.coalesce(F.try_element_at(named, x), open_name, x))

    pieces = F.split(c, _REFERENCE, -1)
    chars = F.concat(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), 0), decoded), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, ch: F.concat(p, ch)), "")
    return _unless_contains(c, "&", joined, c)


# -- D5 / D6 ------------------------------------------------------------------
def _any_substring(lowered: Column, words) -> Column:
    cond = F.lit(False)
    for w in dict.fromkeys(words):           # de-duplicate, keep order
        cond = cond | lowered.contains(w)
    return cond


def is_resume(col, keywords, sections, titles, company_words=None,
              date_pattern: str = L.DATE_PATTERN) -> Column:
    """(keyword or section as lower-case substring) and (date or title word [or company word])."""
    c = _c(col)
    lowered = F.lower(c)
    text_hit = _any_substring(lowered, list(keywords) + list(sections))
    # date OR title OR company: a disjunction of searches is one search of the
    # union pattern, so a single regex pass decides all three.
    words = list(titles) + list(company_words or [])
    evidence = c.rlike(java_regex("(?:" + date_pattern + r")|\b(?i:" + "|".join(words) + r")\b"))
    return text_hit & evidence          # And short-circuits: no regex when no keyword


def is_resume_v1(col) -> Column:
    return is_resume(col, L.RESUME_V1_KEYWORDS, L.RESUME_V1_SECTIONS, L.RESUME_V1_TITLES,
                     L.RESUME_V1_COMPANY_WORDS)


def is_resume_v2(col) -> Column:
    return is_resume(col, L.RESUME_V2_KEYWORDS, L.RESUME_V2_SECTIONS, L.RESUME_V2_TITLES)


# -- D7 - D12 -----------------------------------------------------------------
def extract_all(col, py_pattern: str, group: int = 0) -> Column:
    """``re.findall`` for one group (an unmatched group yields '')."""
    return F.regexp_extract_all(_c(col), F.lit(java_regex(py_pattern)), group)


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def extract_emails(col) -> Column:
    return _unless_contains(_c(col), "@", extract_all(col, L.EMAIL_PATTERN), _empty_strings())


PHONE_TYPE = "array<struct<country:string,area:string,prefix:string,line:string>>"


def _anchored(py_pattern: str) -> str:
    """The pattern matched against one of its own matches: edge ``\\b`` become anchors."""
    p = py_pattern
    if p.startswith(r"\b"):
        p = p[2:]
    if p.endswith(r"\b"):
        p = p[:-2]
    return java_regex("^(?:" + p + ")$")


def extract_phones(col) -> Column:
    """``re.findall`` of the 4-group phone pattern -> array of (country, area, prefix, line).

    One scan of the text finds the matches; each (short) match is then re-matched
    with the pattern anchored to read its groups.  The engine tries the same
    alternatives in the same order, and the boundary tests already held for the
    matched span, so the groups equal those of the full-text match.
    """
    c = _c(col)
    whole = F.regexp_extract_all(c, F.lit(java_regex(L.PHONE_PATTERN)), 0)
    # every phone has digits: texts without one skip the (costly) pattern
    whole = F.when(~c.rlike(java_regex(r"\d")), F.array().cast("array<string>")).otherwise(whole)
    anchored = _anchored(L.PHONE_PATTERN)
    return F.transform(whole, lambda m: F.struct(
        *[F.regexp_extract(m, anchored, g).alias(n)
          for g, n in ((1, "country"), (2, "area"), (3, "prefix"), (4, "line"))]))


def extract_linkedin(col) -> Column:
    return _unless_contains(_c(col), "http", extract_all(col, L.LINKEDIN_PATTERN), _empty_strings())


def extract_github(col) -> Column:
    return _unless_contains(_c(col), "http", extract_all(col, L.GITHUB_PATTERN), _empty_strings())


def extract_urls(col) -> Column:
    return _unless_contains(_c(col), "http", extract_all(col, L.URL_PATTERN), _empty_strings())


def contact_info(col) -> Column:
    """All contact fields of (already cleaned) text as one struct."""
    return F.struct(
        extract_emails(col).alias("emails"),
        extract_phones(col).alias("phone_numbers"),
        extract_linkedin(col).alias("linkedin"),
        extract_github(col).alias("github"),
        extract_urls(col).alias("urls"),
    )


def phones_as_text(col) -> Column:
    """Flatten phone structs to 'country|area|prefix|line;...' (stable, comparable form)."""
    return F.array_join(F.transform(_c(col), lambda p: F.concat_ws(
        "|", p["country"], p["area"], p["prefix"], p["line"])), ";")
