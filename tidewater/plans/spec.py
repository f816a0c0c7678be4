"""A declarative project specification, and its compilation to one predicate."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import patterns


@dataclass(frozen=True)
class Spec:
    start: str
    end: str
    any_of: tuple[str | Mapping[str, object], ...] = ()
    all_of: tuple[str | Mapping[str, object], ...] = ()
    none_of: tuple[str | Mapping[str, object], ...] = ()
    hashtags: tuple[str | Mapping[str, object], ...] = ()
    languages: tuple[str, ...] = ()
    min_likes: int = 0
    originals_only: bool = True
    #: Of the second source: party, chamber, state, handles.
    congress: Mapping[str, object] | None = None

    def canonical_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def problems(spec: Spec, today: dt.date | None = None) -> list[tuple[str, str]]:
    """(code, message) of everything wrong with the specification; nothing is mended silently."""
    found = []
    try:
        start, end = dt.date.fromisoformat(spec.start), dt.date.fromisoformat(spec.end)
        if start >= end:
            found.append(("EMPTY_WINDOW", f"{spec.start} is not before {spec.end}"))
        if today and start > today:
            found.append(("FUTURE_WINDOW", f"{spec.start} is after {today}"))
    except ValueError as e:
        found.append(("BAD_DATE", str(e)))
    if spec.min_likes < 0:
        found.append(("BAD_LIKES", "min_likes is negative"))
    for term in (*spec.any_of, *spec.all_of, *spec.none_of):
        try:
            pattern_of(term)
        except (ValueError, KeyError) as e:
            found.append(("BAD_TERM", str(e)))
    for tag in spec.hashtags:
        try:
            hashtag_of(tag)
        except ValueError as e:
            found.append(("BAD_HASHTAG", str(e)))
    if unknown := set(spec.congress or ()) - {"party", "chamber", "state", "handles"}:
        found.append(("BAD_CONGRESS", f"unknown keys {sorted(unknown)}"))
    return found


def warnings(spec: Spec, posts: int | None = None, days: int | None = None, cap: int | None = None) -> list[tuple[str, str]]:
    """(code, message) of what a valid specification may be wrong about, from its own fields and a preview's figures."""
    found = []
    if not (spec.any_of or spec.all_of or spec.hashtags or spec.congress):
        found.append(("NO_TERMS", "every post of the window matches"))
    if any(len(str(t if isinstance(t, str) else t.get("term", ""))) <= 2 for t in spec.any_of):
        found.append(("SHORT_TERM", "a term of two characters or fewer matches much else"))
    if posts == 0:
        found.append(("NO_MATCHES", "nothing in the window matches"))
    if posts and days and posts < 30 * days:
        found.append(("THIN", "fewer than 30 posts a day"))
    if posts and cap and posts > cap:
        found.append(("SAMPLED", f"{posts} posts are cut to {cap} by day"))
    return found


def hashtag_of(tag: str | Mapping[str, object]) -> str:
    """The pattern of a hashtag given as text or as a term object, which may say whether case counts but not how to match."""
    if isinstance(tag, str):
        return patterns.hashtag(tag)
    if not isinstance(tag, Mapping):
        raise ValueError("a hashtag must be a string or an object")
    if unknown := set(tag) - {"term", "match", "case_sensitive"}:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    if tag.get("match", "substring") != "substring":
        raise ValueError("match is not allowed for a hashtag; give a word in any_of")
    return patterns.hashtag(str(tag.get("term", "")), bool(tag.get("case_sensitive", False)))


def pattern_of(term: str | Mapping[str, object]) -> str:
    if isinstance(term, str):
        return patterns.substring(term)
    unknown = set(term) - {"term", "match", "case_sensitive"}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    make = {"word": patterns.whole_word, "substring": patterns.substring}[str(term.get("match", "substring"))]
    return make(str(term["term"]), bool(term.get("case_sensitive", False)))


def compile_filter(spec: Spec, columns: Mapping[str, str], ntz: bool = False) -> Column:
    """One predicate; ``columns`` names the source's columns, and a condition on one that it lacks is refused."""
    if wrong := problems(spec):
        raise ValueError(wrong)

    def col(name: str) -> Column:
        if name not in columns:
            raise ValueError(f"the source has no {name}")
        return F.col(columns[name])

    kind = "timestamp_ntz" if ntz else "timestamp"
    at = col("created_at")
    parts = [at.isNotNull() & (at >= F.lit(spec.start).cast(kind)) & (at < F.lit(spec.end).cast(kind))]
    for group in ([pattern_of(t) for t in spec.any_of], [hashtag_of(t) for t in spec.hashtags]):
        if group:  # each group must be met by one of its own
            parts.append(reduce(Column.__or__, [col("text").rlike(x) for x in group]))
    parts += [col("text").rlike(pattern_of(t)) for t in spec.all_of] + [~col("text").rlike(pattern_of(t)) for t in spec.none_of]
    if spec.languages:
        parts.append(col("lang").isin(*spec.languages))
    if spec.min_likes:
        parts.append(col("likes") >= spec.min_likes)
    if wanted := dict(spec.congress or {}):
        if wanted.get("party"):
            parts.append(F.lower(col("party")) == str(wanted["party"]).lower())
        if wanted.get("chamber"):
            parts.append(patterns.chamber(col("chamber")) == patterns.chamber(F.lit(str(wanted["chamber"]))))
        if wanted.get("state"):
            parts.append(F.upper(col("state")) == str(wanted["state"]).upper())
        if handles := [str(h).lstrip("@").strip().lower() for h in wanted.get("handles") or ()]:
            parts.append(F.lower(col("author_handle")).isin(*handles))
    if spec.originals_only:
        parts.append(~col("text").startswith("RT @"))
        parts += [F.coalesce(F.col(columns[c]), F.lit("")) == "" for c in ("reply_to", "quoting") if c in columns]
    return reduce(Column.__and__, parts)
