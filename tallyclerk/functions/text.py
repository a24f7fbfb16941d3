"""Column functions that prepare text: decoding, folding, canonical form, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyclerk import vocab as V

# White space of Python's `str`, as a Java/RE2 class body.
_SPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NON_ASCII = r"[^\x00-\x7F]"

# Code points that NFKC can turn into ASCII, or that can merge with an ASCII letter before
# them.  A superset by block: a hit only decides that a text takes the exact, slower path.
FOLDS_TO_ASCII = (
    r"[\x{a0}-\x{be}\x{130}-\x{149}\x{17f}\x{1c4}-\x{1f3}\x{2b0}-\x{2e4}\x{37a}-\x{387}"
    r"\x{1d2c}-\x{1dbf}\x{1e9a}-\x{1e9b}\x{1fbd}-\x{1fff}\x{2000}-\x{24ff}\x{2a74}-\x{2a76}"
    r"\x{2c7c}-\x{2c7d}\x{3000}-\x{33ff}\x{a69c}-\x{a7ff}\x{ab5b}-\x{ab6b}\x{fb00}-\x{fb29}"
    r"\x{fc5e}-\x{fc63}\x{fdfa}-\x{fe7f}\x{ff00}-\x{ffef}\x{10780}-\x{107ba}"
    r"\x{1ccd6}-\x{1ccf9}\x{1d400}-\x{1d7ff}\x{1f100}-\x{1f2ff}\x{1fbf0}-\x{1fbf9}\p{M}]"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(_col(c), F.lit(V.UNICODE_SPACE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(V.UNICODE_SPACE))


def is_empty(c: Column | str) -> Column:
    """Whether nothing but white space is there; a text is read only up to its first other character."""
    return F.ltrim(_col(c), F.lit(V.UNICODE_SPACE)) == ""


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"[{_SPACE_CLASS}]+", " "))


def canonical(c: Column | str) -> Column:
    """Canonical body used by every phrase test: collapsed and upper-cased; NULL is ''."""
    return F.upper(collapse(F.coalesce(_col(c), F.lit(""))))


@F.pandas_udf(StringType())
def _nfkc_ascii(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.encode("ascii", "ignore").str.decode("ascii")


def fold_ascii(c: Column | str, exact: bool = True) -> Column:
    """NFKC, then drop what is not ASCII.

    Most text is ASCII or holds characters that are simply dropped; both stay in the JVM.
    Only texts with compatibility or combining characters are handed to the Arrow
    function (the others reach it as NULL).  ``exact=False`` leaves that step out.
    """
    c = _col(c)
    ascii_only = F.octet_length(c) == F.length(c)
    plain = F.when(ascii_only, c).otherwise(F.regexp_replace(c, NON_ASCII, ""))
    if not exact:
        return plain
    hard = F.when(~ascii_only & c.rlike(FOLDS_TO_ASCII), c)
    return F.coalesce(_nfkc_ascii(hard), plain)


def strip_non_ascii(c: Column | str, exact: bool = True) -> Column:
    return strip(fold_ascii(c, exact))


def decode_bytes(content: Column | str) -> Column:
    """Bytes to text: UTF-8 if valid, else Windows-1252, else Latin-1; NULL stays NULL.

    Windows-1252 differs from Latin-1 only in 0x80-0x9F, so it is Latin-1 plus a
    character translation, which needs no Python.
    """
    content = _col(content)
    as_utf8 = content.cast("string")
    latin1 = F.decode(content, "ISO-8859-1")
    undefined = "[" + "".join(rf"\x{{{b:x}}}" for b in V.CP1252_UNDEFINED) + "]"
    c1 = "".join(chr(b) for b in V.CP1252_BYTES)
    cp1252 = F.translate(latin1, c1, V.CP1252_CHARS)
    return (
        F.when(F.is_valid_utf8(as_utf8), as_utf8)
        .when(latin1.rlike(undefined), latin1)
        .otherwise(cp1252)
    )


def is_readable(text: Column | str) -> Column:
    """More than 40 characters once trimmed; NULL is unreadable."""
    return F.coalesce(F.length(strip(text)) > V.MIN_USEFUL_CHARS, F.lit(False))


def is_poor(text: Column | str) -> Column:
    """Recognised text too short, too few words, or too little of it letters and digits."""
    t = strip(F.coalesce(_col(text), F.lit("")))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    # From the first letter or digit of a token to its end: one match a token, in linear time.
    words = F.regexp_count(t, F.lit(rf"[\p{{L}}\p{{N}}][^{_SPACE_CLASS}]*+"))
    return (
        F.when(F.length(t) < V.QUALITY_MIN_CHARS, True)
        .when(words < V.QUALITY_MIN_TOKENS, True)
        .otherwise(alnum / F.length(t) < V.QUALITY_MIN_RATIO)
    )


def extension(path: Column | str) -> Column:
    """Lower-cased suffix of the last path part, '' when there is none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)/*$", 1))


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def join_pages(pages: Column | str) -> Column:
    """Pages joined by a blank line; pages holding only white space are dropped."""
    return F.concat_ws("\n\n", F.filter(_col(pages), lambda p: strip(p) != ""))


def numbered_lines(text: Column | str) -> Column:
    """Array of (line, text): numbered from 1, right-trimmed."""
    return F.transform(
        F.split(_col(text), "\n"),
        lambda t, i: F.struct((i + 1).alias("line"), rstrip(t).alias("text")),
    )


def sender_domain(sender: Column | str) -> Column:
    return F.lower(F.substring_index(_col(sender), "@", -1))


def reference_number(subject: Column | str) -> Column:
    """First booking reference in a subject by two patterns in order, '' when none."""
    s = F.coalesce(_col(subject), F.lit(""))
    found = [F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in V.REFERENCE_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def content_key(c: Column | str, digits: int = 20) -> Column:
    """Leading hex digits of SHA-256: the key of the answer cache."""
    return F.substring(F.sha2(_col(c), 256), 1, digits)
