import pytest
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions import text as X


@pytest.mark.parametrize("text, topic", [
    ("officials said output was flat", None), ("new AI chip", "AI 반도체"), ("ai가 온다", None), ("ai, again", "AI 반도체"),
    ("rate hike ahead", "금리 인상"), ("Iran war", "지정학 해소"), ("missile test", "지정학 리스크"), ("휴전 협상", "지정학 해소"),
    ("opec cut, oil drop", "유가 상승"), ("nothing here", None), ("defense budget", "국방비 증가"),
])
def test_topic(evaluate, text, topic):
    assert evaluate(X.detect_topic(F.lit(text))) == topic


@pytest.mark.parametrize("text, phrase", [
    ("Fed minutes and rate hike", "federal reserve building washington"),
    ("nothing", C.DEFAULT_COVER), ("said", "glowing microchip blue server room"), ("휴전", "diplomacy handshake global"),
])
def test_cover_phrase_first_key_wins(evaluate, text, phrase):
    assert evaluate(X.cover_phrase(F.lit(text))) == phrase


def test_every_rule_topic_has_a_cover():
    assert {t for t, *_ in C.MACRO_RULES} == {t for t, _ in C.TOPIC_COVERS}


@pytest.mark.parametrize("title, summary, hit", [
    ("Corporate news", "", True), ("", "OPEC meets", True), ("quiet day", None, False), (None, None, False),
])
def test_keyword_is_a_substring_of_both(evaluate, title, summary, hit):
    lit = lambda v: F.lit(v).cast("string")
    assert evaluate(X.keyword_match(lit(title), lit(summary))) is hit


def test_similarity(evaluate):
    a, b = F.lit("연준 금리 5.50% 인상"), F.lit("유로존 물가 2.8% 반등")
    assert evaluate(X.similarity(a, a)) == 1.0
    assert evaluate(X.similarity(a, b)) == evaluate(X.similarity(b, a)) < 0.3
    assert evaluate(X.similarity(F.lit(""), a)) == 0.0
    assert evaluate(X.similarity(F.lit("a b c"), F.lit("b c d"))) == 0.5


@pytest.mark.parametrize("url, slug", [
    ("https://www.instagram.com/p/Abc-1_x/", "ig_Abc-1_x"), ("https://www.instagram.com/reel/Zz/?x=1", "ig_Zz"),
    ("https://youtu.be/q-1", "yt_q-1"), ("https://www.youtube.com/watch?v=YW&t=3", "yt_YW"),
    ("https://www.youtube.com/shorts/s1", "yt_s1"), ("http://example.org/a/b?c=d", "yt_http_example_org_a_b_c_d"),
])
def test_slug(evaluate, url, slug):
    assert evaluate(X.post_slug(F.lit(url))) == slug


def test_cache_key_depends_on_every_part(evaluate):
    import hashlib
    key = lambda *p: evaluate(X.content_key(*[F.lit(x) for x in p]))
    assert key("m", "v", "text") == hashlib.sha256(b"m\x1fv\x1ftext").hexdigest()[:32]
    assert len({key("m", "v", "t"), key("m", "w", "t"), key("m", "v", "u"), key("n", "v", "t")}) == 4


def test_number_mentions(evaluate):
    assert evaluate(X.number_mentions(F.lit("1,200원 2.5% 3 달러 7"))) == ["1,200원", "2.5%", "3 달러", "7"]


def test_short_label(evaluate):
    assert evaluate(X.short_label(F.lit("a" * 50))) == "a" * 50
    assert evaluate(X.short_label(F.lit("a" * 51))) == "a" * 50 + "..."


def test_keyword_terms_use_unicode_word_limits(evaluate):
    assert evaluate(X.keyword_terms(F.lit("The éabc abc1 def 금리 a_bcd 금 xyz가나"))) == ["the", "def", "금리", "가나"]
