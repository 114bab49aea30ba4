"""Checks and repairs on generated records held in nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import (
    contains_any, has_near_copy, let, outlet_of, strip, text_or_empty, tokens,
)

SECTOR_LIST = "array<struct<name:string,reason:string>>"
STRINGS = "array<string>"


def _quoted(before: str, text: Column, after: str = "'") -> Column:
    return F.concat(F.lit(before), text, F.lit(after))


def _list(col: Column, kind: str = STRINGS) -> Column:
    return F.coalesce(col, F.array().cast(kind))


def find_banned(text: Column) -> Column:
    """The banned phrases that occur in the text, in list order."""
    return F.filter(
        F.array([F.lit(p) for p in C.BANNED_PHRASES]), lambda p: F.contains(text_or_empty(text), p)
    )


def has_banned(text: Column) -> Column:
    return contains_any(text_or_empty(text), C.BANNED_PHRASES)


def clean_sources(sources: Column, limit: int = C.MAX_SOURCES) -> Column:
    """Known outlets named in a list of source strings, distinct, in order, at most ``limit``."""
    found = F.array_compact(F.transform(_list(sources), outlet_of))
    return let(
        F.slice(F.array_distinct(found), 1, limit),
        lambda s: F.when(F.size(s) > 0, s).otherwise(F.array([F.lit(x) for x in C.DEFAULT_SOURCES])),
    )


def reason_owners(reason: Column) -> Column:
    """Sectors whose signature words occur in the reason, in table order."""
    return let(
        text_or_empty(reason),
        lambda r: F.array_compact(
            F.array([F.when(contains_any(r, words), F.lit(s)) for s, words in C.REASON_SIGNATURES])
        ),
    )


def wrong_owner(name: Column, reason: Column) -> Column:
    """Sector the reason really speaks about, null if the given name is fine."""
    return let(
        reason_owners(reason),
        lambda o: F.when((F.size(o) > 0) & ~F.array_contains(o, name), F.try_element_at(o, F.lit(1))),
    )


def repair_sectors(sectors: Column, side: str) -> Column:
    """Ordered repair of a sector list: struct(kept, issues).

    Unknown names and banned reasons go; a reason that speaks about another sector moves
    to that sector if it is still free, else goes; a repeated name goes.
    """

    def checked(s: Column) -> Column:
        name, reason = strip(text_or_empty(s["name"])), strip(text_or_empty(s["reason"]))
        return F.struct(
            name.alias("name"),
            reason.alias("reason"),
            name.isin(C.SECTORS).alias("known"),
            has_banned(reason).alias("banned"),
            wrong_owner(name, reason).alias("owner"),
        )

    def step(acc: Column, s: Column) -> Column:
        target = F.coalesce(s["owner"], s["name"])
        usable = s["known"] & ~s["banned"]
        free = ~F.array_contains(acc["kept"]["name"], target)
        moved = s["owner"].isNotNull()
        message = (
            F.when(~s["known"], _quoted(f"{side} 비허용 섹터명 drop: '", s["name"]))
            .when(s["banned"], _quoted(f"{side} 금지어 포함 섹터 drop: '", s["name"]))
            .when(moved & free, F.concat(_quoted(f"{side} 섹터-이유 불일치: '", s["name"]),
                                         _quoted(" → '", s["owner"], "' 교체")))
            .when(moved, F.concat(_quoted(f"{side} 섹터-이유 불일치 drop: '", s["name"]),
                                  _quoted(" (이유: ", F.substring(s["reason"], 1, 30), "…)")))
            .when(~free, _quoted(f"{side} 중복 섹터 drop: '", s["name"]))
        )
        keep = F.when(usable & free, F.array(F.struct(target.alias("name"), s["reason"].alias("reason"))))
        return F.struct(
            F.concat(acc["kept"], _list(keep, SECTOR_LIST)).alias("kept"),
            F.concat(acc["issues"], F.array_compact(F.array(message))).alias("issues"),
        )

    start = F.struct(
        F.array().cast(SECTOR_LIST).alias("kept"), F.array().cast(STRINGS).alias("issues")
    )
    return F.aggregate(F.transform(_list(sectors, SECTOR_LIST), checked), start, step)


def _token_sets(texts: Column) -> Column:
    """Token sets of the non-empty texts of a list."""
    return F.transform(F.filter(texts, lambda t: t != ""), tokens)


def drop_repeats(summaries: Column, fact_sets: Column) -> Column:
    """Ordered scan: struct(kept, issues); a summary near a fact or a kept summary goes."""

    def step(acc: Column, s: Column) -> Column:
        words = s["words"]
        repeat = s["near_fact"] | has_near_copy(words, acc["sets"])
        message = F.concat(F.lit("slide5 요약 중복 drop: '"), F.substring(s["text"], 1, 30), F.lit("…'"))
        return F.struct(
            F.when(repeat, acc["kept"]).otherwise(F.array_append(acc["kept"], s["text"])).alias("kept"),
            F.when(repeat | (s["text"] == ""), acc["sets"])
            .otherwise(F.array_append(acc["sets"], words)).alias("sets"),
            F.when(repeat, F.array_append(acc["issues"], message)).otherwise(acc["issues"]).alias("issues"),
        )

    prepared = F.transform(
        summaries,
        lambda t: let(tokens(t), lambda w: F.struct(
            t.alias("text"), w.alias("words"), has_near_copy(w, fact_sets).alias("near_fact"))),
    )
    start = F.struct(
        F.array().cast(STRINGS).alias("kept"),
        F.array().cast("array<array<string>>").alias("sets"),
        F.array().cast(STRINGS).alias("issues"),
    )
    return F.aggregate(prepared, start, step)


def blank_repeated_fact(fact: Column, fact_sets: Column, sectors: Column) -> Column:
    """Empty text if the fact repeats a slide-2 fact or a reason of its own sectors."""
    fact = text_or_empty(fact)
    reasons = _token_sets(F.transform(_list(sectors, SECTOR_LIST), lambda s: text_or_empty(s["reason"])))
    repeated = let(tokens(fact), lambda w: has_near_copy(w, F.concat(fact_sets, reasons)))
    return F.when((fact != "") & repeated, F.lit("")).otherwise(fact)


def cover_texts(df: DataFrame, issues: str = "cover_issues") -> DataFrame:
    """Replace a hook or one-line text without Hangul by the default text."""
    hook, line = text_or_empty(F.col("hook_title")), text_or_empty(F.col("one_line"))
    no_hook, no_line = ~hook.rlike("[가-힣]"), ~line.rlike("[가-힣]")
    return df.withColumns({
        issues: F.array_compact(F.array(
            F.when(no_hook, _quoted("영문/빈 hook_title 교체: '", F.substring(hook, 1, 20))),
            F.when(no_line, _quoted("영문/빈 one_line 교체: '", F.substring(line, 1, 30))),
        )),
        "hook_title": F.when(no_hook, F.lit(C.DEFAULT_HOOK)).otherwise(hook),
        "one_line": F.when(no_line, F.lit(C.DEFAULT_ONE_LINE)).otherwise(line),
    })


def dedupe_record(df: DataFrame) -> DataFrame:
    """Remove repeats between slides of the flat slide columns; adds ``repeat_issues``."""
    df = df.withColumn("_sets", _token_sets(_list(F.col("slide2_facts"))))
    df = df.withColumns({
        "_f3": blank_repeated_fact(F.col("slide3_fact"), F.col("_sets"), F.col("slide3_sectors")),
        "_f4": blank_repeated_fact(F.col("slide4_fact"), F.col("_sets"), F.col("slide4_sectors")),
        "_sum": drop_repeats(_list(F.col("slide5_summaries")), F.col("_sets")),
    })

    def note(key: str, new: str) -> Column:
        changed = (text_or_empty(F.col(key)) != "") & (F.col(new) == "")
        return F.when(changed, F.lit(f"{key} 중복 → FACT 박스 생략"))

    return df.withColumns({
        "repeat_issues": F.concat(
            F.array_compact(F.array(note("slide3_fact", "_f3"), note("slide4_fact", "_f4"))),
            F.col("_sum.issues"),
        ),
        "slide3_fact": F.col("_f3"),
        "slide4_fact": F.col("_f4"),
        "slide5_summaries": F.col("_sum.kept"),
    }).drop("_sets", "_f3", "_f4", "_sum")


def is_viable() -> Column:
    """Enough content left on every slide."""
    return (
        (F.size(_list(F.col("slide2_facts"))) >= C.MIN_FACTS)
        & (F.size(_list(F.col("slide3_sectors"), SECTOR_LIST)) >= C.MIN_SECTORS)
        & (F.size(_list(F.col("slide4_sectors"), SECTOR_LIST)) >= C.MIN_SECTORS)
        & (F.size(_list(F.col("slide5_summaries"))) >= C.MIN_SUMMARIES)
    )


def validate_record(df: DataFrame) -> DataFrame:
    """Full check of the flat slide columns; adds ``viable`` and ``issues``.

    Order: banned phrases, sector lists, repeats, amount of content.
    """

    def dropped(col: str, what: str) -> Column:
        bad = F.filter(_list(F.col(col)), has_banned)
        return F.transform(
            bad, lambda t: F.concat(F.lit(f"금지어 {what} drop: '"), F.substring(t, 1, 30), F.lit("…'"))
        )

    watch = text_or_empty(F.col("slide5_watch_point"))
    df = df.withColumns({
        "_banned": F.concat(
            dropped("slide2_facts", "팩트"),
            dropped("slide5_summaries", "요약"),
            F.array_compact(F.array(F.when(has_banned(watch), F.lit("금지어 watch_point 비움")))),
        ),
        "slide2_facts": F.filter(_list(F.col("slide2_facts")), lambda t: ~has_banned(t)),
        "slide5_summaries": F.filter(_list(F.col("slide5_summaries")), lambda t: ~has_banned(t)),
        "slide5_watch_point": F.when(has_banned(watch), F.lit("")).otherwise(F.col("slide5_watch_point")),
        "_s3": repair_sectors(F.col("slide3_sectors"), C.BENEFIT_SIDE),
        "_s4": repair_sectors(F.col("slide4_sectors"), C.CAUTION_SIDE),
    })
    df = df.withColumns({"slide3_sectors": F.col("_s3.kept"), "slide4_sectors": F.col("_s4.kept")})
    df = dedupe_record(df).withColumn("viable", is_viable())
    shortage = F.when(~F.col("viable"), F.lit("검증 후 콘텐츠 부족 → fallback 필요"))
    return df.withColumn(
        "issues",
        F.concat(
            F.col("_banned"), F.col("_s3.issues"), F.col("_s4.issues"), F.col("repeat_issues"),
            F.array_compact(F.array(shortage)),
        ),
    ).drop("_banned", "_s3", "_s4", "repeat_issues")
