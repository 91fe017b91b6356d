"""Text columns: normalising, measuring and cutting strings inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that str.strip() takes for white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body that Java and RE2 both read.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHARS = r"\p{L}\p{M}\p{N}_"
# Words, spelled for Java: its own white-space class is far quicker to match.
WORD_CHAR = r"[\S&&[^\x1c-\x1f]]"
WORD_RUN = f"(?U){WORD_CHAR}+"
TOKEN = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE}]"
TOKEN_AND_BLANK = f"(?:{TOKEN})[{SPACE}]*"
SENTENCE_END = r"(?U)([.!?…]+)[\s\x1c-\x1f]+"
_MARK = "\x01"

# Typographic variants and what they become.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
BULLETS = "\u2022\u2023\u2043\u2219\u25e6\u25aa\u25ab\u25cf\u25cb\u25a0\u25a1"
ODD_SPACES = "\u00a0\u2007\u202f\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
DROPPED = "\u200b\u2060"
# Marks in front of and behind a list item.
ITEM_PREFIX = r"\-\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\x{00B7}\*\x{25AA}\x{25CF}"
ITEM_SUFFIX = ".,;:·•-–—"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use at several places of ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


# Anything but ASCII and the letters of Latin-1, all of which NFKC leaves alone.
BEYOND_LATIN_1 = r"[\x80-\xbf\x{100}-\x{10ffff}]"


@lru_cache(maxsize=1)
def _may_change_under_nfkc() -> str:
    """Regex that finds any character compatibility composition could touch.

    Assigned characters that are their own NFKC form and never join the
    character before them are left out: not marks, and not the parts of Hangul
    syllables. So letters, dashes, bullets, quotes and currency signs need no
    Python at all.
    """
    stable = [
        cp
        for cp in range(0x80, 0x3000)
        if unicodedata.category(chr(cp))[0] not in "MC"
        and not 0x1100 <= cp <= 0x11FF
        and unicodedata.normalize("NFKC", chr(cp)) == chr(cp)
    ]
    ranges: list[list[int]] = []
    for cp in stable:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    ranges.append([0x4E00, 0x9FA5])
    body = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"[^\\x00-\\x7f{body}]"


def nfkc(c: Column) -> Column:
    """Compatibility composition; plain rows reach Python as nulls only."""

    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    compose.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Two ranges settle most rows before the long character class is tried.
    touched = F.when(c.rlike(BEYOND_LATIN_1) & c.rlike(_may_change_under_nfkc()), c)
    return F.coalesce(F.pandas_udf(compose, T.StringType())(touched), c)


def tidy_text(c: Column) -> Column:
    """``normalize_text`` after its Unicode step."""
    source = DASHES + BULLETS + ODD_SPACES + DROPPED
    target = "-" * len(DASHES + BULLETS) + " " * len(ODD_SPACES)
    c = F.translate(c, source, target)
    c = F.regexp_replace(c, "-{2,}", "-")
    # Runs shrink to one blank before the line-end rule, which keeps both linear.
    c = F.regexp_replace(c, "[ \\t]{2,}", " ")
    c = F.regexp_replace(c, "[ \\t]\\n", "\n")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return strip(c)


def normalize_text(c: Column) -> Column:
    """NFKC, plain dashes / bullets / blanks, collapsed runs, stripped."""
    return tidy_text(nfkc(c))


def clean_string(c: Column) -> Column:
    """Missing becomes empty; byte-order marks and outer blanks go."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit("")))


def slugify(c: Column) -> Column:
    folded = F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))
    slug = F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("term"))


def quote_plus(c: Column) -> Column:
    """Form encoding with the unreserved set ``A-Za-z0-9_.-~``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(c: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/search?q="), quote_plus(c))


def resolve_link(href: Column, base: str) -> Column:
    """Absolute address of ``href`` seen from a site root (no dot segments)."""
    m = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/?#]*)(.*)$", base)
    if not m:
        raise ValueError(f"not an absolute address: {base}")
    scheme, site = m.group(1) + ":", m.group(2)
    path = re.split("[?#]", m.group(3))[0] or "/"
    page, folder = scheme + site + path, path.rsplit("/", 1)[0] + "/"
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(scheme), href))
        .when(F.startswith(href, F.lit("/")), F.concat(F.lit(scheme + site), href))
        .when((href == "") | href.rlike("^[?#]"), F.concat(F.lit(page), href))
        .otherwise(F.concat(F.lit(scheme + site + folder), href))
    )


def clean_qualification(c: Column) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, f"(?U)^[\\s\\x1c-\\x1f{ITEM_PREFIX}]+", "")
    c = strip(F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", " "))
    return F.rtrim(c, F.lit(ITEM_SUFFIX))


def text_md5(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def paragraph_uid(des: Column, par: Column) -> Column:
    return F.concat(F.lit("D"), des.cast("string"), F.lit("_P"), par.cast("string"))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RUN))


def at_most_words(stripped: Column, n: int) -> Column:
    """A stripped text of one to ``n`` words; stops reading after them."""
    gap = r"[\s\x1c-\x1f]+"
    return stripped.rlike(f"(?U)^{WORD_CHAR}++(?:{gap}{WORD_CHAR}++){{0,{n - 1}}}\\z")


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def count_sentences(c: Column) -> Column:
    """Sentences end at ``. ! ?`` runs followed by a blank, or at the end."""
    return let(
        strip(c),
        lambda s: F.when(s == "", F.lit(0)).otherwise(F.regexp_count(s, F.lit(SENTENCE_END)) + 1),
    )


def sentences(c: Column) -> Column:
    marked = F.regexp_replace(c, SENTENCE_END, "$1" + _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda s: s != "")


def text_lengths(c: Column, tokenizer: Callable[[Column], Column] | None = None) -> dict[str, Column]:
    """Code points, words and tokens; two tokens stand for the sequence marks."""
    n_tokens = tokenizer(c) if tokenizer else count_tokens(c) + 2
    return {"n_chars": F.length(c), "n_words": count_words(c), "n_tokens": n_tokens}


def split_lines(c: Column) -> Column:
    """Stripped non-empty lines; one empty line for a text without any."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    return non_empty_text(lines)


def non_empty_text(parts: Column) -> Column:
    """Drop blank parts, but keep one empty placeholder for none at all."""
    return let(
        F.filter(parts, lambda x: strip(x) != ""),
        lambda kept: F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept),
    )
