import pytest
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom import schemas
from newsloom.functions import records as R
from newsloom.operators import factcheck as FC


def sectors(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("reason")) for n, r in pairs])


def repaired(evaluate, *pairs):
    row = evaluate(R.repair_sectors(sectors(*pairs), C.BENEFIT_SIDE))
    return [(s["name"], s["reason"]) for s in row["kept"]], row["issues"]


INSURANCE = "시장 금리 상승으로 보험 운용자산 수익률이 높아졌다"


def test_reason_of_another_sector_moves_there(evaluate):
    kept, issues = repaired(evaluate, ("바이오·제약", INSURANCE))
    assert kept == [("보험", INSURANCE)] and len(issues) == 1


def test_reason_is_dropped_when_its_sector_is_taken(evaluate):
    kept, issues = repaired(evaluate, ("보험", "보험금 지급이 줄었다"), ("바이오·제약", INSURANCE))
    assert [n for n, _ in kept] == ["보험"] and len(issues) == 1


def test_unknown_names_and_repeats_are_dropped(evaluate):
    kept, issues = repaired(evaluate, ("NVDA", "x"), ("테슬라", "y"), (" 보험 ", "변동성"), ("보험", "변동성 둘"))
    assert kept == [("보험", "변동성")] and len(issues) == 3


def test_plain_and_banned_reasons(evaluate):
    assert repaired(evaluate, ("정유업종", "일반적인 이유다"))[1] == []
    assert repaired(evaluate, ("정유업종", "지금 매수해야 한다"))[0] == []


@pytest.mark.parametrize("given, want", [
    (["Reuters: record low", "Reuters: second", "Reuters: third"], ["Reuters"]),
    (["CNBC", "Bloomberg", "FT", "WSJ"], ["CNBC", "Bloomberg", "FT"]),
    (["unknown blog"], ["Reuters"]), ([], ["Reuters"]), (None, ["Reuters"]), ([None, "nyt"], ["NYT"]),
])
def test_clean_sources(spark, given, want):
    df = spark.createDataFrame([(given,)], "s array<string>")
    assert df.select(R.clean_sources(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text, banned", [
    ("상승이 예상된다", True), ("지금 매수", True), ("추천 종목", True), ("오를 것", True),
    ("금리가 올랐다", False), ("물가가 반등했다", False), ("", False),
])
def test_banned(evaluate, text, banned):
    assert bool(evaluate(R.find_banned(F.lit(text)))) is banned
    assert evaluate(R.has_banned(F.lit(text))) is banned


GOOD = dict(
    hook_title="물가", one_line="요약", sources=["Reuters"], image_keyword="",
    slide2_facts=["연준이 금리를 동결했다", "유로존 물가는 2.8% 올랐다"], slide2_source="출처",
    slide3_sectors=[("보험", "보험 수익이 늘었다")], slide3_fact="환율이 1,400원을 넘었다",
    slide4_sectors=[("건설업종", "조달 비용이 커졌다")], slide4_fact="재고가 줄었다",
    slide5_summaries=["긴축 국면이 길어졌다", "업종별 온도 차가 뚜렷하다"], slide5_watch_point="다음 회의",
)


def record(spark, **changes):
    values = {**GOOD, **changes}
    names = [p.split()[0] for p in schemas.DRAFT.split(", ")]
    return spark.createDataFrame([tuple(values[n] for n in names)], schemas.DRAFT)


def validated(spark, **changes):
    return R.validate_record(record(spark, **changes)).first()


def test_good_record_is_untouched(spark):
    row = validated(spark)
    assert row["viable"] and row["issues"] == [] and row["slide3_fact"] == GOOD["slide3_fact"]


def test_repeated_fact_boxes_are_blanked(spark):
    fact = GOOD["slide2_facts"][0]
    row = R.dedupe_record(record(spark, slide3_fact=fact, slide4_fact="조달 비용이 커졌다")).first()
    assert (row["slide3_fact"], row["slide4_fact"]) == ("", "") and len(row["repeat_issues"]) == 2


def test_near_copied_summary_is_removed(spark):
    row = R.dedupe_record(record(spark, slide5_summaries=["유로존 물가는 2.8% 올랐다", "긴축 국면", "긴축 국면", ""])).first()
    assert row["slide5_summaries"] == ["긴축 국면", ""] and len(row["repeat_issues"]) == 2


def test_defects_are_repaired_in_order(spark):
    row = validated(
        spark, slide2_facts=[*GOOD["slide2_facts"], "주가가 오를 것"], slide5_watch_point="매도 시점",
        slide3_sectors=[("바이오·제약", INSURANCE), ("AAPL", "x")],
    )
    assert row["viable"] and len(row["slide2_facts"]) == 2 and row["slide5_watch_point"] == ""
    assert [s["name"] for s in row["slide3_sectors"]] == ["보험"]
    assert [i.split()[0] for i in row["issues"]] == ["금지어", "금지어", "수혜", "수혜"]


def test_thin_record_is_not_viable(spark):
    row = validated(spark, slide2_facts=["하나"], slide3_sectors=None, slide4_sectors=[], slide5_summaries=None)
    assert not row["viable"] and row["issues"][-1].startswith("검증 후")


def test_second_pass_changes_nothing(spark):
    first = R.validate_record(record(spark, slide3_sectors=[("바이오·제약", INSURANCE)], slide5_watch_point="추천"))
    second = R.validate_record(first.drop("viable", "issues")).first()
    assert second["issues"] == [] and second["viable"]


def test_cover_texts(spark):
    row = R.cover_texts(record(spark, hook_title="English", one_line=None)).first()
    assert (row["hook_title"], row["one_line"]) == (C.DEFAULT_HOOK, C.DEFAULT_ONE_LINE) and len(row["cover_issues"]) == 2
    assert R.cover_texts(record(spark)).first()["hook_title"] == "물가"


RATE = "연준 rate hike 발표"


@pytest.mark.parametrize("text, pos, neg, trend, status", [
    (RATE, ["바이오·제약"], ["은행·금융"], (5, 1.0), "failed"), (RATE, ["은행·금융"], ["건설업종"], (5, 1.0), "passed"),
    (RATE, ["바이오·제약"], [], (5, -3.0), "failed"), (RATE, ["은행·금융"], [], (5, -3.0), "warning"),
    (RATE, ["은행·금융"], [], (5, -0.5), "passed"), (RATE, ["은행·금융"], [], (1, -9.0), "passed"),
    ("새 정책", ["반도체 기업"], ["보험"], (5, -3.0), "passed"), ("Iran", ["방산업체"], [], (5, -1.0), "failed"),
])
def test_fact_check(spark, text, pos, neg, trend, status):
    df = spark.createDataFrame([(text, pos, neg)], "t string, p array<string>, n array<string>")
    trends = spark.createDataFrame([("^TNX", *trend), ("CL=F", *trend)], "ticker string, n_days bigint, pct double")
    fc = FC.fact_check(df, F.col("t"), F.col("p"), F.col("n"), trends).first()["fact_check"]
    assert fc["status"] == status
    if status == "failed" and text == RATE:
        assert {"은행·금융", "보험"} & set(fc["correct_pos"]) and fc["topic"] == "금리 인상"


def test_rule_words(evaluate):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert evaluate(FC.words_to_sectors(words("은행", "금융", "조선", "항공"))) == ["은행·금융", "조선", "항공사들"]
    assert set(evaluate(FC.expand_sectors(words("은행·금융", "x")))) == {"은행·금융", "은행", "금융", "x"}


def test_corrected_sectors_keep_reasons_by_place(evaluate):
    old = sectors(("보험", "첫째 이유"))
    fixed = evaluate(FC.correct_sectors(F.array(F.lit("조선"), F.lit("보험"), F.lit("은행·금융"), F.lit("건설업종")), old))
    assert [tuple(s) for s in fixed] == [("보험", "첫째 이유"), ("은행·금융", C.DEFAULT_REASON)]
    assert [s["name"] for s in evaluate(FC.correct_sectors(F.array(F.lit("조선")), old))] == ["보험"]
