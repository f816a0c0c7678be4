"""Text patterns and normal forms with ASCII word rules and Unicode case folding, as Java regular expressions."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = "A-Za-z0-9_"


def quoted(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}#&~-])", r"\\\1", term)


def substring(term: str, case_sensitive: bool = False) -> str:
    if not term.strip():
        raise ValueError("an empty term matches everything")
    return ("" if case_sensitive else "(?iu)") + quoted(term)


def whole_word(term: str, case_sensitive: bool = False) -> str:
    """The term with a word edge beside each ASCII word character at its ends."""
    if not term.isascii():
        raise ValueError(f"{term!r}: word edges are defined for ASCII terms only")
    left, right = re.match(f"[{WORD}]", term), re.search(f"[{WORD}]$", term)
    if not (left or right):
        raise ValueError(f"{term!r} has no word character at either end")
    return ("" if case_sensitive else "(?iu)") + (f"(?<![{WORD}])" if left else "") + quoted(term) + (f"(?![{WORD}])" if right else "")


def chamber(name: Column) -> Column:
    """Senate, House or null, whatever the spelling: of a member's title, a chamber's name or its initial."""
    low = F.lower(F.trim(name))
    return F.when(low.rlike(r"^(?:u\.?s\.? )?sen|^s$|upper"), "Senate").when(low.rlike(r"^(?:u\.?s\.? )?(?:house|rep|congress)|^h$|lower"), "House")


def hashtag(tag: str, case_sensitive: bool = False) -> str:
    tag = tag.removeprefix("#")
    if not re.fullmatch(r"\w+", tag):
        raise ValueError(f"{tag!r} is no hashtag")
    return f"{'' if case_sensitive else '(?iu)'}#{quoted(tag)}(?:[^{WORD}]|$)"


def preview_term(keyword: str) -> str:
    """Short or all-capital keywords match as whole words, others anywhere; case is ignored."""
    k = keyword.strip()
    return whole_word(k) if k.isascii() and re.search(r"\w", k) and (len(k) <= 4 or k.isupper()) else substring(k)


def live_terms(terms: list[str]) -> str:
    """One pattern of whole words by Unicode rules; capitals of up to five letters keep their case."""
    one = [quoted(t) if t.isupper() and len(t) <= 5 else f"(?iu:{quoted(t)})" for t in terms]
    return rf"(?U)(?<!\w)(?:{'|'.join(one)})(?!\w)"


def plain(text: Column) -> Column:
    """Lower case without links and mentions, one blank between words."""
    for pattern in (r"https?://\S+", r"@[A-Za-z0-9_]+", r"\s+"):
        text = F.regexp_replace(F.lower(text), pattern, " ")
    return F.trim(text)


def template(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+|@[A-Za-z0-9_]+", " "), r"\s+", " "))


def folded(text: Column, n: int = 100) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), r"[^a-z0-9]+", " ")), F.lit(n))


def model_input(text: Column) -> Column:
    """Mentions and links as the marks ``@user`` and ``http``."""
    mark = lambda x: F.when(x.startswith("@") & (F.length(x) > 1), "@user").when(x.startswith("http"), "http").otherwise(x)
    return F.array_join(F.transform(F.split(text, " "), mark), " ")


def key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def composed(text: Column) -> Column:
    """Canonical composition (NFC), which no built-in expression has.

    The function is local, so that executors get its code and need no copy of the library.
    """

    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(nfc, StringType())(text)


def slug(name: str, taken: set[str]) -> str:
    """Letters and digits of a name joined by hyphens; a number follows where the result is taken."""
    base = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "untitled"
    return next(s for n in itertools.count(1) if (s := base if n == 1 else f"{base}-{n}") not in taken)


def dash_folded(text: Column) -> Column:
    return F.translate(F.lower(text), "‐‑‒–—−", "------")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, path without a last slash, query without utm_ parts, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[a-zA-Z]+://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[a-zA-Z]+://[^/?]*([^?]*)", 1), "/$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def burst_plain(text: Column) -> Column:
    """Links, mentions, entities and the mark of a repost become blanks; lower case."""
    return F.lower(F.regexp_replace(text, r"https?://\S+|@\w+|&\w+;|^RT\b", " "))
