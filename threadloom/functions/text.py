"""Column functions on text. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.catalogue import PROFANITY, SALE_PHRASES

# Patterns of the text cleaner, in the order they apply.
MENTION = r"@\w+"
URL = r"https?://\S+"
SYMBOL_ASCII = r"[^\w\s#\x{1F300}-\x{10FFFF}]+"
SYMBOL_UNICODE = r"[^\p{L}\p{M}\p{N}_\s#\x{1F300}-\x{10FFFF}]+"
PRICE = r"(?i)[0-9]+\s*tr($|[^\p{L}\p{M}\p{N}_])"

_EDGE = r"\p{L}\p{M}\p{N}_"


def clean_text(col: Column, unicode: bool = False) -> Column:
    """Drop mentions, links and symbols (``#`` and emoji stay), squeeze blanks, trim.

    By default only ASCII letters count as word characters, so accented
    letters are dropped; ``unicode=True`` keeps letters of every script."""
    # Most texts hold neither a mention nor a link: a substring test spares them the pattern.
    # Dropping a mention cannot form a new link, so both tests look at the original text.
    spoken = F.when(F.contains(col, F.lit("@")), F.regexp_replace(col, MENTION, "")).otherwise(col)
    linkless = F.when(F.contains(col, F.lit("http")), F.regexp_replace(spoken, URL, "")).otherwise(spoken)
    plain = F.regexp_replace(linkless, SYMBOL_UNICODE if unicode else SYMBOL_ASCII, "")
    return F.trim(F.regexp_replace(plain, r"\s{2,}", " "))


def words_pattern(words: Sequence[str]) -> str:
    """Pattern for "one of these words stands alone", for boolean matching.

    Word edges are spelled out instead of ``\\b``, whose meaning for accented
    letters changed between JDK releases."""
    return rf"(?i)(^|[^{_EDGE}])({'|'.join(map(re.escape, words))})($|[^{_EDGE}])"


def mentions_any(col: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.regexp_like(col, F.lit(words_pattern(words))), F.lit(False))


def sale_pattern(phrases: Sequence[str] = SALE_PHRASES) -> str:
    alternatives = "|".join(p.replace(" ", r"[\s_]?") for p in phrases)
    return rf"(?iu)(?<![{_EDGE}])({alternatives})(?![{_EDGE}])"


def is_sale(col: Column) -> Column:
    """Text offers or asks for a resale. NULL text does not; case folds in every script."""
    return F.coalesce(F.regexp_like(col, F.lit(sale_pattern())), F.lit(False))


def names_price(col: Column) -> Column:
    """Text quotes a price in millions ("500 tr"); NULL does not."""
    return F.coalesce(F.regexp_like(col, F.lit(PRICE)), F.lit(False))


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def first_tokens(col: Column, n: int = 50) -> Column:
    """The first ``n`` white-space separated tokens, blank-joined; NULL gives ''."""
    trimmed = F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", "")
    return F.array_join(F.slice(F.split(trimmed, r"\s+"), 1, n), " ")


def preview(col: Column, n: int = 200) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, n)


def surrogate_key(*cols: Column) -> Column:
    """First 16 hex digits of the sha-256 of the values joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)


def fold_tags(tags: Column) -> Column:
    """Lower-cased tags without NULLs; NULL gives an empty array."""
    return F.transform(F.coalesce(F.array_compact(tags), F.array().cast("array<string>")), F.lower)


def keyword_match(folded_text: Column, folded_tags: Column, keywords: Sequence[str]) -> Column:
    """A keyword is a substring of the lower-cased text or equals a lower-cased tag."""
    hit = F.arrays_overlap(folded_tags, F.array(*[F.lit(k) for k in keywords]))
    for keyword in keywords:
        hit = hit | F.coalesce(F.contains(folded_text, F.lit(keyword)), F.lit(False))
    return hit


def profanity_pattern(entries: Sequence[str] = PROFANITY) -> str:
    def one(entry: str) -> str:
        start = "(?<![A-Za-z0-9_])" if entry.startswith("|") else ""
        end = "(?![A-Za-z0-9_])" if entry.endswith("|") else ""
        return start + re.escape(entry.strip("|")) + end

    return f"(?iu)({'|'.join(map(one, entries))})"


def mask_profanity(col: Column, mask: str = "***", pattern: str | None = None) -> Column:
    return F.regexp_replace(col, pattern or profanity_pattern(), mask)


def profanity_segments(col: Column, pattern: str | None = None) -> Column:
    """The text cut into ``struct(text, flagged)`` pieces, in order, without empty pieces."""
    pattern = pattern or profanity_pattern()
    clean = F.split(col, pattern, -1)
    hits = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))

    def piece(text: Column, flagged: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(flagged).alias("flagged"))

    pairs = F.zip_with(clean, hits, lambda c, h: F.array(piece(c, False), piece(h, True)))
    return F.filter(F.flatten(pairs), lambda p: F.coalesce(p["text"], F.lit("")) != "")
