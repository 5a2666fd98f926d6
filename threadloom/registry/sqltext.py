"""SQL building blocks for the checks, in the DuckDB dialect."""

from __future__ import annotations

from threadloom.registry import adapters as a


def clean(col: str, unicode: bool = False) -> str:
    symbols = r"[^\p{L}\p{M}\p{N}_\s#\x{1F300}-\x{10FFFF}]" if unicode else r"[^\w\s#\x{1F300}-\x{10FFFF}]"
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({col}, '@\w+', '', 'g'),"
        rf" 'https?://\S+', '', 'g'), '{symbols}', '', 'g'), '\s{{2,}}', ' ', 'g'))"
    )


def hits(col: str, words) -> str:
    return f"len(regexp_extract_all(lower({col}), '{'|'.join(words)}'))"


def label(col: str, lexicon=a.LEXICON) -> str:
    p, n = hits(col, lexicon.positive), hits(col, lexicon.negative)
    return f"CASE WHEN {p} > {n} THEN 'positive' WHEN {n} > {p} THEN 'negative' ELSE 'neutral' END"


def score(col: str, lexicon=a.LEXICON) -> str:
    p, n = hits(col, lexicon.positive), hits(col, lexicon.negative)
    return f"CAST(CASE WHEN {p} + {n} > 0 THEN greatest({p}, {n}) / ({p} + {n}) ELSE 1.0 END AS FLOAT)"


def stance(reply: str, parent: str) -> str:
    yes, no = hits(reply, a.STANCE.positive), hits(reply, a.STANCE.negative)
    return (
        f"CASE WHEN trim(coalesce({parent}, '')) = '' THEN 'neutral'"
        f" WHEN {yes} > 0 AND {yes} >= {no} THEN 'agreement' WHEN {no} > 0 THEN 'disagreement' ELSE 'neutral' END"
    )


def keyword(brand) -> str:
    tests = [f"contains(lower(text), '{k}')" for k in brand.keywords]
    tests += [f"list_contains(list_transform(coalesce(hashtags, []), lambda t: lower(t)), '{k}')"
              for k in brand.keywords]
    return "(" + " OR ".join(tests) + ")"


def half_up(part: str, total: str, digits: int = 4) -> str:
    """part / total rounded half up in integer arithmetic; NULL for a zero total. For non-negative numbers."""
    scale = 10 ** digits
    return (
        f"(CAST(CASE WHEN ({total}) > 0 THEN (2 * CAST({part} AS HUGEINT) * {scale} + ({total}))"
        f" // (2 * ({total})) END AS DOUBLE) / {scale})"
    )


# Flat posts and quoted posts; copies of a quoted id: greatest day, likes, reposts, url wins.
FLAT = f"""flat AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingestion_date DESC, "likeCount" DESC NULLS LAST,
      "retweetCount" DESC NULLS LAST, url DESC) AS rn
    FROM (
      SELECT * FROM {a.duck(a.POSTS)}
      UNION ALL BY NAME
      SELECT * REPLACE (concat('q', cast(doc_id // 3 AS string)) AS id, concat(url, '?q') AS url)
      FROM {a.duck(a.POSTS)} WHERE k % 5 < 2)
  ) WHERE rn = 1)"""

SILVER = FLAT + f""", silver AS (
  SELECT * REPLACE ({clean('text')} AS text), stamp AS created_at_ts
  FROM flat
  WHERE id IS NOT NULL AND text IS NOT NULL AND author_id IS NOT NULL AND NOT no_author_stamp AND NOT bad_stamp
    AND "retweetCount" >= 0 AND "likeCount" >= 0 AND "replyCount" >= 0 AND "quoteCount" >= 0)"""

_found = ", ".join(f"CASE WHEN {keyword(b)} THEN '{b.name}' END" for b in a.BRANDS)
_age = f"greatest((epoch(TIMESTAMP '{a.AS_OF}') - epoch(created_at_ts)) / 3600.0, 0.0)"
ENGAGEMENT = (
    '(ln(coalesce("likeCount",0) + coalesce("retweetCount",0) * 2.0 + coalesce("replyCount",0) * 1.5'
    ' + coalesce("quoteCount",0) * 2.0 + 1) * 0.5'
    " + log10(coalesce(author_followers,0) + 1) * CASE WHEN author_is_blue_verified THEN 1.2 ELSE 1.0 END * 0.3)"
    f" / ln({_age} + exp(1.0::DOUBLE))"
)
VIRAL = 1.0
ANALYTICS = SILVER + f""", analytics AS (
  SELECT *, list_filter([{_found}], lambda x: x IS NOT NULL) AS all_brands,
    coalesce(list_filter([{_found}], lambda x: x IS NOT NULL)[1], 'Unknown') AS primary_brand,
    CAST({ENGAGEMENT} AS DOUBLE) AS engagement_score, {ENGAGEMENT} >= {VIRAL} AS is_viral,
    CASE WHEN author_following > 0 THEN author_followers / author_following END AS author_influence_ratio,
    author_statuses_count > 50000 AND author_followers < 500 AS is_bot,
    {label('text')} AS sentiment_label, {score('text')} AS sentiment_score
  FROM silver)"""
