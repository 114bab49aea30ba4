"""Check of sector claims against macro rules and price trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import detect_topic, lookup
from newsloom.operators.trend import trend_agrees

RESULT = "struct<status:string,topic:string,message:string,correct_pos:array<string>,correct_neg:array<string>>"


def macro_rules(spark: SparkSession) -> DataFrame:
    """The fixed rule table: topic, ticker, expected, gain, lose."""
    return spark.createDataFrame(
        C.MACRO_RULES, "topic string, ticker string, expected string, gain array<string>, lose array<string>"
    )


def _words(values: list[str]) -> Column:
    return F.array([F.lit(v) for v in values]).cast("array<string>")


def expand_sectors(names: Column) -> Column:
    """Sector names together with their rule words."""

    def words(name: Column) -> Column:
        chain = None
        for sector, tokens in C.SECTOR_ALIASES:
            chain = F.when(name == sector, _words(tokens)) if chain is None else chain.when(name == sector, _words(tokens))
        return chain.otherwise(_words([]))

    names = F.coalesce(names, _words([]))
    return F.array_distinct(F.concat(names, F.flatten(F.transform(names, words))))


def words_to_sectors(words: Column) -> Column:
    """Rule words as sector names, in order and once; unknown words stay."""
    owner = {}
    for sector, tokens in C.SECTOR_ALIASES:
        for token in tokens:
            owner.setdefault(token, sector)
    table = list(owner.items())
    return F.array_distinct(F.transform(F.coalesce(words, _words([])), lambda w: F.coalesce(lookup(w, table), w)))


def _set_text(words: Column) -> Column:
    quoted = F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'")))
    return F.when(F.size(words) == 0, F.lit("set()")).otherwise(
        F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))
    )


def fact_check(df: DataFrame, text: Column, gain: Column, lose: Column, trends: DataFrame | None = None,
               out: str = "fact_check") -> DataFrame:
    """Add ``out``: status, topic, message and, after a conflict, the right sectors.

    A sector conflict outranks a price mismatch. ``trends`` is (ticker, n_days, pct); without
    it prices are not checked. Only the eleven rules and their trends are broadcast.
    """
    rules = macro_rules(df.sparkSession)
    if trends is None:
        rules = rules.withColumns({"n_days": F.lit(0).cast("bigint"), "pct": F.lit(0.0)})
    else:
        rules = rules.join(trends.select("ticker", "n_days", "pct"), "ticker", "left")
    rules = rules.select(
        F.col("topic").alias("_topic"),
        F.struct("ticker", "gain", "lose", "pct", trend_agrees(F.col("expected"), F.col("n_days"), F.col("pct"))
                 .alias("agrees")).alias("_rule"),
    )
    rule, topic = F.col("_rule"), F.col("_topic")
    df = df.withColumn("_topic", detect_topic(text)).join(F.broadcast(rules), "_topic", "left").withColumns({
        "_wrong_gain": F.array_sort(F.array_intersect(expand_sectors(gain), rule["lose"])),
        "_wrong_lose": F.array_sort(F.array_intersect(expand_sectors(lose), rule["gain"])),
    })
    conflict = (F.size("_wrong_gain") > 0) | (F.size("_wrong_lose") > 0)
    none = F.lit(None)

    def result(status: str, topic_: Column, message: Column, pos: Column = none, neg: Column = none) -> Column:
        return F.struct(
            F.lit(status).alias("status"), topic_.cast("string").alias("topic"), message.alias("message"),
            pos.cast("array<string>").alias("correct_pos"), neg.cast("array<string>").alias("correct_neg"),
        )

    failed = F.concat(
        F.lit("경제 논리 오류: 수혜에 잘못 포함된 섹터 "), _set_text(F.col("_wrong_gain")),
        F.lit(", 주의에 잘못 포함된 섹터 "), _set_text(F.col("_wrong_lose")),
    )
    warning = F.concat(
        F.lit("시장 데이터 불일치: "), rule["ticker"], F.lit(" 실제 "),
        F.call_function("format_number", rule["pct"], F.lit("0.0")),
        F.lit("% 변동 (예상 방향과 다름). 면책 문구 추가 권장."),
    )
    checked = (
        F.when(rule.isNull(), result("passed", none, F.lit("알 수 없는 토픽, 검증 통과")))
        .when(conflict, result("failed", topic, failed, words_to_sectors(F.array_sort(rule["gain"])),
                               words_to_sectors(F.array_sort(rule["lose"]))))
        .when(~rule["agrees"], result("warning", topic, warning))
        .otherwise(result("passed", topic, F.concat(F.lit("'"), topic, F.lit("' 검증 통과"))))
    )
    return df.withColumn(out, checked).drop("_topic", "_rule", "_wrong_gain", "_wrong_lose")


def correct_sectors(correct: Column, old: Column) -> Column:
    """First two valid corrected sectors with the old reasons by place; else the old list."""
    names = F.slice(F.filter(F.coalesce(correct, _words([])), lambda n: n.isin(C.SECTORS)), 1, 2)

    def rebuilt(name: Column, i: Column) -> Column:
        reason = F.try_element_at(old, i + 1)["reason"]
        return F.struct(
            name.alias("name"),
            F.when(F.coalesce(reason, F.lit("")) != "", reason).otherwise(F.lit(C.DEFAULT_REASON)).alias("reason"),
        )

    return F.when(F.size(names) > 0, F.transform(names, rebuilt)).otherwise(old)
