"""Text expressions: containment, first match, token sets, slugs, number mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import constants as C

# what str.strip() removes, for F.trim with an explicit set
BLANKS = " \t\n\r\f\x0b"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space (``F.trim`` alone drops only spaces)."""
    return F.trim(col, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A filter with thirty ``contains(lower(text), ...)`` would otherwise lower-case a
    whole article thirty times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """True if one of the phrases occurs as a plain substring."""
    result = F.lit(False)
    for phrase in phrases:
        result = result | F.contains(text, F.lit(phrase))
    return result


def keyword_match(title: Column, summary: Column, keywords: Sequence[str] = C.MACRO_KEYWORDS) -> Column:
    """Case-insensitive substring match of any keyword in ``title + ' ' + summary``."""
    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(summary)))
    return let(text, lambda t: contains_any(t, [k.lower() for k in keywords]))


def first_match(text: Column, table: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first key (in table order) that occurs in ``text``."""
    chain = None
    for key, value in table:
        hit = F.contains(text, F.lit(key))
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(default))


def has_word(text: Column, word: str) -> Column:
    """Whole-word match where letters of every script count as word characters."""
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)")


def detect_topic(text: Column) -> Column:
    """First macro topic named in the text, null if none."""

    def chain(low: Column) -> Column:
        result = F.lit(None).cast("string")
        for topic, words in reversed(C.TOPIC_WORDS):
            hit = contains_any(low, words)
            if topic == C.AI_TOPIC:
                hit = hit | (F.contains(low, F.lit(C.AI_WORD)) & has_word(low, C.AI_WORD))
            result = F.when(hit, F.lit(topic)).otherwise(result)
        return result

    return let(F.lower(text), chain)


def cover_phrase(text: Column) -> Column:
    """Picture-search phrase of the first dictionary key in the text."""
    return let(F.lower(text), lambda t: first_match(t, C.COVER_PHRASES, C.DEFAULT_COVER))


def lookup(key: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Exact lookup in a small fixed table, null if absent."""
    chain = None
    for name, value in table:
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain.otherwise(F.lit(None))


def outlet_of(text: Column) -> Column:
    """First known outlet named in the text, null if none."""
    return let(F.lower(text), lambda t: first_match(t, C.OUTLETS))


def feed_source(url: Column) -> Column:
    """Outlet of a feed address, ``Unknown`` if none fits."""
    return first_match(url, C.FEED_SOURCES, C.UNKNOWN_SOURCE)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of Hangul, Latin letters, digits, dots and percent signs."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(C.TOKEN_PATTERN), F.lit(0))
    )


def token_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; 0.0 if either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


def similarity(left: Column, right: Column) -> Column:
    """Token Jaccard of two texts."""
    return token_jaccard(tokens(left), tokens(right))


def at_least_similar(left: Column, right: Column, threshold: float = C.DUPLICATE_JACCARD) -> Column:
    """Token Jaccard of at least ``threshold``; sets of too different size are not compared."""
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    return F.when(small < large * threshold - 1e-9, F.lit(False)).otherwise(token_jaccard(left, right) >= threshold)


def has_near_copy(token_set: Column, others: Column, threshold: float = C.DUPLICATE_JACCARD) -> Column:
    """True if one of the token sets in ``others`` is at least ``threshold`` similar."""
    return F.exists(others, lambda o: at_least_similar(token_set, o, threshold))


def number_mentions(text: Column) -> Column:
    """Numbers with their unit, in order of appearance."""
    return F.transform(
        F.regexp_extract_all(text_or_empty(text), F.lit(f"({C.NUMBER_PATTERN})"), F.lit(1)), strip
    )


def post_slug(url: Column) -> Column:
    """Folder name of a post or video address."""
    post_id = F.regexp_extract(url, C.POST_ID_PATTERN, 1)
    cleaned = F.regexp_replace(url, r"[^\p{L}\p{N}_]+", "_")
    core = F.when(post_id != "", post_id).otherwise(F.right(cleaned, F.lit(C.SLUG_CHARS)))
    platform = F.when(F.contains(url, F.lit("instagram.com")), F.lit("ig")).otherwise(F.lit("yt"))
    return F.concat(platform, F.lit("_"), core)


def platform_of(url: Column) -> Column:
    """Which collector an address belongs to."""
    return first_match(
        url,
        [("instagram.com", "instagram"), ("youtube.com", "youtube"), ("youtu.be", "youtube")],
        "unsupported",
    )


def weighted_text(title: Column, body: Column | None, weight: int = C.TITLE_WEIGHT,
                  body_chars: int = C.BODY_CHARS) -> Column:
    """Title repeated ``weight`` times followed by the head of the body."""
    heads = F.repeat(F.concat(text_or_empty(title), F.lit(" ")), weight)
    return heads if body is None else F.concat(heads, F.substring(text_or_empty(body), 1, body_chars))


def short_label(title: Column, limit: int = C.LABEL_CHARS) -> Column:
    """Cut a long label and mark the cut."""
    return F.when(
        F.length(title) > limit, F.concat(F.substring(title, 1, limit), F.lit("..."))
    ).otherwise(title)


def content_key(model: Column, version: Column, material: Column) -> Column:
    """Key of a cached result: hash of model, prompt version and material."""
    payload = F.concat(
        text_or_empty(model), F.lit("\x1f"), text_or_empty(version), F.lit("\x1f"), text_or_empty(material)
    )
    return F.substring(F.sha2(payload, 256), 1, C.CACHE_KEY_CHARS)


def article_id(url: Column, title: Column) -> Column:
    """Stable article id, equal on every re-run."""
    return F.sha2(F.concat(text_or_empty(url), F.lit("\x1f"), text_or_empty(title)), 256)


def keyword_terms(text: Column) -> Column:
    """Latin words of three or more letters and Hangul runs of two or more."""
    pattern = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])|[가-힣]{2,}"
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(pattern), F.lit(0))
