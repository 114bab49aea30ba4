"""Queries for record repair, fact check and the script plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions import records as R
from newsloom.operators import factcheck as FC
from newsloom.operators import trend as T
from newsloom.queries.rank_queries import PRICES, TREND_SQL, prices
from newsloom.queries.registry import ARTICLES, articles, query, sql_any, sql_list, sql_text
from newsloom.queries.text_queries import JACCARD_SQL, TOKENS_SQL, topic_sql

NAMES = C.SECTORS + ["NVDA", "테슬라", "", " 보험 "]
REASONS = [
    "금리 인상으로 예대마진이 개선됐다", "보험 운용자산 수익률이 높아졌다", "신약 임상 부담이 커졌다", "정제마진이 넓어졌다",
    "항공유 부담이 커졌다", "운임이 올랐다", "변동성이 커졌다", "반도체 메모리 가격이 올랐다", "지금 매수 기회라는 말이 많다",
    "수주잔고가 늘었다", "소비 심리가 위축됐다", "전력망 투자가 늘었다",
]


def _nth(values, shift):
    return F.element_at(F.array([F.lit(v) for v in values]), ((F.col("pos") + shift) % len(values)).cast("int") + 1)


def _nth_sql(values, shift):
    return f"list_extract({sql_list(values)}, CAST((pos + {shift}) % {len(values)} AS INTEGER) + 1)"


def _sectors(shift):
    first = F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))
    pairs = [(_nth(NAMES, shift), _nth(REASONS, shift)), (_nth(NAMES, shift + 3), _nth(REASONS, shift + 5)),
             (_nth(NAMES, shift + 8), _nth(REASONS, 2 * shift + 1)), (_nth(NAMES, shift), first)]
    return F.array([F.struct(n.alias("name"), r.alias("reason")) for n, r in pairs])


def _sectors_sql(shift):
    pairs = [(_nth_sql(NAMES, shift), _nth_sql(REASONS, shift)), (_nth_sql(NAMES, shift + 3), _nth_sql(REASONS, shift + 5)),
             (_nth_sql(NAMES, shift + 8), _nth_sql(REASONS, 2 * shift + 1)), (_nth_sql(NAMES, shift), "coalesce(lines[1], '')")]
    return "[" + ", ".join(f"{{'name': {n}, 'reason': {r}}}" for n, r in pairs) + "]"


# Every document as a generated draft: its lines become facts, summaries and fact boxes;
# names, reasons and flawed parts follow from the document number.
DRAFTS = ARTICLES + f""",
split_lines AS (SELECT pos, title, source, list_filter(string_split(summary, chr(10)), lambda l: l <> '') AS lines FROM articles),
drafts AS (SELECT pos, CAST(pos AS VARCHAR) AS issue_id,
  CASE WHEN pos % 3 = 0 THEN '금리 인상 ' || title WHEN pos % 3 = 1 THEN '반도체 ' || title ELSE title END AS hook_title,
  CASE WHEN pos % 2 = 0 THEN '시장 요약' ELSE source END AS one_line,
  list_concat(list_filter(lines, lambda l, i: i % 3 = 1), CASE WHEN pos % 5 = 0 THEN [coalesce(lines[1], '') || ' 추천'] ELSE [] END) AS facts,
  {_sectors_sql(0)} AS gain_list, {_sectors_sql(7)} AS lose_list,
  coalesce(lines[CASE WHEN pos % 4 = 0 THEN 1 ELSE 3 END], '') AS fact3, coalesce(lines[3], '') AS fact4,
  list_concat(list_filter(lines, lambda l, i: i % 3 = 2), CASE WHEN pos % 4 = 1 THEN [coalesce(lines[1], '')] ELSE [] END) AS sums,
  coalesce(lines[1], '') || CASE WHEN pos % 6 = 0 THEN ' 매도' ELSE '' END AS watch FROM split_lines)"""


def drafts(spark, sf_dir):
    pos, lines = F.col("pos"), F.col("lines")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    third = F.coalesce(F.try_element_at(lines, F.lit(3)), F.lit(""))
    none = F.array().cast("array<string>")
    rows = articles(spark, sf_dir).withColumn("lines", F.filter(F.split("summary", "\n", -1), lambda t: t != ""))
    return rows.select(
        "pos", pos.cast("string").alias("issue_id"),
        F.when(pos % 3 == 0, F.concat(F.lit("금리 인상 "), "title"))
        .when(pos % 3 == 1, F.concat(F.lit("반도체 "), "title")).otherwise(F.col("title")).alias("hook_title"),
        F.when(pos % 2 == 0, "시장 요약").otherwise(F.col("source")).alias("one_line"),
        F.array("source", F.lit("CNBC")).alias("sources"), F.lit("").alias("image_keyword"),
        F.concat(
            F.filter(lines, lambda t, i: i % 3 == 0),
            F.when(pos % 5 == 0, F.array(F.concat(first, F.lit(" 추천")))).otherwise(none),
        ).alias("slide2_facts"),
        F.lit("출처").alias("slide2_source"),
        _sectors(0).alias("slide3_sectors"), F.when(pos % 4 == 0, first).otherwise(third).alias("slide3_fact"),
        _sectors(7).alias("slide4_sectors"), third.alias("slide4_fact"),
        F.concat(
            F.filter(lines, lambda t, i: i % 3 == 1), F.when(pos % 4 == 1, F.array(first)).otherwise(none)
        ).alias("slide5_summaries"),
        F.concat(first, F.when(pos % 6 == 0, " 매도").otherwise("")).alias("slide5_watch_point"),
    )


def _owners_sql(reason):
    cases = ", ".join(f"CASE WHEN {sql_any(reason, w)} THEN {sql_text(s)} END" for s, w in C.REASON_SIGNATURES)
    return f"list_filter([{cases}], lambda o: o IS NOT NULL)"


PAIR = "STRUCT(name VARCHAR, reason VARCHAR)"
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def repair_sql(col, side):
    """Ordered fold: every element carries empty result lists, the running one has them filled."""
    trimmed = (f"list_transform({col}, lambda s: {{'name': trim(coalesce(s.name, ''), {BLANKS_SQL}),"
               f" 'reason': trim(coalesce(s.reason, ''), {BLANKS_SQL})}})")
    owned = (f"list_transform({trimmed}, lambda s: {{'name': s.name, 'reason': s.reason,"
             f" 'known': list_contains({sql_list(C.SECTORS)}, s.name), 'banned': {sql_any('s.reason', C.BANNED_PHRASES)},"
             f" 'owners': {_owners_sql('s.reason')}}})")
    ready = (f"list_transform({owned}, lambda s: {{'name': s.name, 'reason': s.reason, 'usable': s.known AND NOT s.banned,"
             " 'known': s.known, 'target': CASE WHEN len(s.owners) > 0 AND NOT list_contains(s.owners, s.name) THEN s.owners[1] ELSE s.name END,"
             f" 'kept': []::{PAIR}[], 'names': []::VARCHAR[], 'issues': []::VARCHAR[]}})")
    message = (
        f"CASE WHEN NOT s.known THEN '{side} 비허용 섹터명 drop: ''' || s.name || ''''"
        f" WHEN NOT s.usable THEN '{side} 금지어 포함 섹터 drop: ''' || s.name || ''''"
        f" WHEN s.target <> s.name AND NOT list_contains(acc.names, s.target) THEN '{side} 섹터-이유 불일치: ''' || s.name || ''' → ''' || s.target || ''' 교체'"
        f" WHEN s.target <> s.name THEN '{side} 섹터-이유 불일치 drop: ''' || s.name || ''' (이유: ' || substring(s.reason, 1, 30) || '…)'"
        f" WHEN list_contains(acc.names, s.target) THEN '{side} 중복 섹터 drop: ''' || s.name || '''' END"
    )
    keep = "s.usable AND NOT list_contains(acc.names, s.target)"
    step = (
        f"{{'name': s.name, 'reason': s.reason, 'usable': s.usable, 'known': s.known, 'target': s.target,"
        f" 'kept': CASE WHEN {keep} THEN list_append(acc.kept, {{'name': s.target, 'reason': s.reason}}) ELSE acc.kept END,"
        f" 'names': CASE WHEN {keep} THEN list_append(acc.names, s.target) ELSE acc.names END,"
        f" 'issues': CASE WHEN {message} IS NULL THEN acc.issues ELSE list_append(acc.issues, {message}) END}}"
    )
    start = (f"{{'name': '', 'reason': '', 'usable': false, 'known': false, 'target': '', 'kept': []::{PAIR}[],"
             " 'names': []::VARCHAR[], 'issues': []::VARCHAR[]}")
    return f"list_reduce({ready}, lambda acc, s: {step}, {start})"


def _pairs_text(col):
    return F.array_join(F.transform(col, lambda s: F.concat(s["name"], F.lit("="), s["reason"])), "|")


PAIRS_SQL = "array_to_string(list_transform({0}, lambda s: s.name || '=' || s.reason), '|')"


@query("sector_repair", f"""
WITH {DRAFTS}, r AS (SELECT pos, {repair_sql('gain_list', '수혜')} AS fixed FROM drafts)
SELECT pos, {PAIRS_SQL.format('fixed.kept')} AS kept, array_to_string(fixed.issues, '|') AS issues FROM r""")
def sector_repair(spark, sf_dir):
    fixed = drafts(spark, sf_dir).select("pos", R.repair_sectors(F.col("slide3_sectors"), C.BENEFIT_SIDE).alias("fixed"))
    return fixed.select("pos", _pairs_text(F.col("fixed.kept")).alias("kept"), F.array_join("fixed.issues", "|").alias("issues"))


def _tokens_sql(col):
    return TOKENS_SQL.format(col)


def _near_sql(words, sets, name):
    return f"len(list_filter({sets}, lambda {name}: {JACCARD_SQL.format(words, name)} >= 0.6)) > 0"


def dedupe_sql(source, gain, lose, facts, sums, f3, f4):
    """CTEs that blank repeated fact boxes and drop repeated summaries of ``source``."""
    fact_sets = f"list_transform(list_filter({facts}, lambda f: f <> ''), lambda f: {_tokens_sql('f')})"

    def reasons(col):
        return f"list_transform(list_filter(list_transform({col}, lambda s: s.reason), lambda f: f <> ''), lambda f: {_tokens_sql('f')})"

    step = (
        "{'text': s.text, 'words': s.words, 'near': s.near,"
        f" 'kept': CASE WHEN s.near OR {_near_sql('s.words', 'acc.sets', 'o')} THEN acc.kept ELSE list_append(acc.kept, s.text) END,"
        f" 'sets': CASE WHEN s.text = '' OR s.near OR {_near_sql('s.words', 'acc.sets', 'o')} THEN acc.sets ELSE list_append(acc.sets, s.words) END,"
        f" 'issues': CASE WHEN s.near OR {_near_sql('s.words', 'acc.sets', 'o')} THEN list_append(acc.issues, 'slide5 요약 중복 drop: ''' || substring(s.text, 1, 30) || '…''') ELSE acc.issues END}}"
    )
    start = "{'text': '', 'words': []::VARCHAR[], 'near': false, 'kept': []::VARCHAR[], 'sets': []::VARCHAR[][], 'issues': []::VARCHAR[]}"
    return f"""
sets AS (SELECT *, {fact_sets} AS fsets, {reasons(gain)} AS gsets, {reasons(lose)} AS lsets,
  list_transform({sums}, lambda t: {{'text': t, 'words': {_tokens_sql('t')}}}) AS stexts FROM {source}),
marked AS (SELECT *, list_transform(stexts, lambda s: {{'text': s.text, 'words': s.words, 'near': {_near_sql('s.words', 'fsets', 'o')},
  'kept': []::VARCHAR[], 'sets': []::VARCHAR[][], 'issues': []::VARCHAR[]}}) AS smarks,
  {f3} <> '' AND {_near_sql(_tokens_sql(f3), 'list_concat(fsets, gsets)', 'o')} AS blank3,
  {f4} <> '' AND {_near_sql(_tokens_sql(f4), 'list_concat(fsets, lsets)', 'o')} AS blank4 FROM sets),
folded AS (SELECT *, list_reduce(smarks, lambda acc, s: {step}, {start}) AS sfold FROM marked),
deduped AS (SELECT *, CASE WHEN blank3 THEN '' ELSE {f3} END AS new3, CASE WHEN blank4 THEN '' ELSE {f4} END AS new4,
  sfold.kept AS new_sums, list_concat(CASE WHEN blank3 THEN ['slide3_fact 중복 → FACT 박스 생략'] ELSE [] END,
  CASE WHEN blank4 THEN ['slide4_fact 중복 → FACT 박스 생략'] ELSE [] END, sfold.issues) AS repeat_issues FROM folded)"""


@query("slide_dedup", f"""
WITH {DRAFTS}, {dedupe_sql('drafts', 'gain_list', 'lose_list', 'facts', 'sums', 'fact3', 'fact4')}
SELECT pos, sha256(new3) AS fact3, sha256(new4) AS fact4, sha256(array_to_string(new_sums, '|')) AS summaries,
  CAST(len(new_sums) AS BIGINT) AS n_summaries, array_to_string(repeat_issues, '|') AS issues FROM deduped""")
def slide_dedup(spark, sf_dir):
    return R.dedupe_record(drafts(spark, sf_dir)).select(
        "pos", F.sha2("slide3_fact", 256).alias("fact3"), F.sha2("slide4_fact", 256).alias("fact4"),
        F.sha2(F.array_join("slide5_summaries", "|"), 256).alias("summaries"),
        F.size("slide5_summaries").cast("bigint").alias("n_summaries"),
        F.array_join("repeat_issues", "|").alias("issues"),
    )


VALIDATED = DRAFTS + f""",
clean AS (SELECT *, list_filter(facts, lambda t: NOT {sql_any('t', C.BANNED_PHRASES)}) AS ok_facts,
  list_filter(sums, lambda t: NOT {sql_any('t', C.BANNED_PHRASES)}) AS ok_sums,
  list_concat(list_transform(list_filter(facts, lambda t: {sql_any('t', C.BANNED_PHRASES)}), lambda t: '금지어 팩트 drop: ''' || substring(t, 1, 30) || '…'''),
    list_transform(list_filter(sums, lambda t: {sql_any('t', C.BANNED_PHRASES)}), lambda t: '금지어 요약 drop: ''' || substring(t, 1, 30) || '…'''),
    CASE WHEN {sql_any('watch', C.BANNED_PHRASES)} THEN ['금지어 watch_point 비움'] ELSE [] END) AS banned_issues,
  CASE WHEN {sql_any('watch', C.BANNED_PHRASES)} THEN '' ELSE watch END AS new_watch,
  {repair_sql('gain_list', '수혜')} AS fixed3, {repair_sql('lose_list', '주의')} AS fixed4 FROM drafts),
{dedupe_sql('clean', 'fixed3.kept', 'fixed4.kept', 'ok_facts', 'ok_sums', 'fact3', 'fact4')},
validated AS (SELECT *, len(ok_facts) >= 2 AND len(fixed3.kept) >= 1 AND len(fixed4.kept) >= 1 AND len(new_sums) >= 2 AS viable,
  list_concat(banned_issues, fixed3.issues, fixed4.issues, repeat_issues, CASE WHEN len(ok_facts) >= 2 AND len(fixed3.kept) >= 1
  AND len(fixed4.kept) >= 1 AND len(new_sums) >= 2 THEN [] ELSE ['검증 후 콘텐츠 부족 → fallback 필요'] END) AS issues FROM deduped)"""


@query("record_validation", f"""
WITH {VALIDATED} SELECT pos, CAST(viable AS BIGINT) AS viable, array_to_string(issues, '|') AS issues,
  sha256(array_to_string(ok_facts, '|')) AS facts, sha256(array_to_string(new_sums, '|')) AS summaries, new_watch AS watch_point,
  {PAIRS_SQL.format('fixed3.kept')} AS gain, {PAIRS_SQL.format('fixed4.kept')} AS lose FROM validated""")
def record_validation(spark, sf_dir):
    return R.validate_record(drafts(spark, sf_dir)).select(
        "pos", F.col("viable").cast("bigint").alias("viable"), F.array_join("issues", "|").alias("issues"),
        F.sha2(F.array_join("slide2_facts", "|"), 256).alias("facts"),
        F.sha2(F.array_join("slide5_summaries", "|"), 256).alias("summaries"),
        F.col("slide5_watch_point").alias("watch_point"),
        _pairs_text(F.col("slide3_sectors")).alias("gain"), _pairs_text(F.col("slide4_sectors")).alias("lose"),
    )


@query("viable_records", f"""
WITH {DRAFTS} SELECT pos FROM drafts WHERE len(facts) >= 2 AND len(gain_list) >= 1 AND len(lose_list) >= 1 AND len(sums) >= 2""")
def viable_records(spark, sf_dir):
    return drafts(spark, sf_dir).filter(R.is_viable()).select("pos")


@query("script_gate", f"""
WITH {VALIDATED} SELECT issue_id, CASE WHEN pos % 9 = 0 THEN 'no slides' WHEN NOT viable THEN 'not viable' ELSE 'ready' END AS state,
  CASE WHEN pos % 9 <> 0 AND viable THEN CASE WHEN regexp_matches(hook_title, '[가-힣]') THEN hook_title ELSE {sql_text(C.DEFAULT_HOOK)} END END AS hook_title
FROM validated""")
def script_gate(spark, sf_dir):
    from newsloom.plans.scripts import SLIDE_COLUMNS, prepare_scripts
    scripts = drafts(spark, sf_dir).select(
        "issue_id", "hook_title", "one_line",
        F.when(F.col("pos") % 9 != 0, F.struct(*SLIDE_COLUMNS)).alias("inner"),
    )
    ready, rejected = prepare_scripts(scripts)
    return ready.select("issue_id", F.lit("ready").alias("state"), "hook_title").unionByName(
        rejected.select("issue_id", F.col("reason").alias("state"), F.lit(None).cast("string").alias("hook_title"))
    )


# -- fact check -----------------------------------------------------------------

ALIAS_SQL = "CASE {0} " + " ".join(f"WHEN {sql_text(s)} THEN {sql_list(w)}" for s, w in C.SECTOR_ALIASES) + " ELSE [] END"
_OWNER: dict[str, str] = {}
for _sector, _words in C.SECTOR_ALIASES:
    for _word in _words:
        _OWNER.setdefault(_word, _sector)
TO_SECTOR_SQL = "CASE {0} " + " ".join(f"WHEN {sql_text(w)} THEN {sql_text(s)}" for w, s in _OWNER.items()) + " ELSE {0} END"
RULES_SQL = "rules(topic, ticker, expected, gain, lose) AS (VALUES " + ", ".join(
    f"({sql_text(t)}, {sql_text(k)}, {sql_text(e)}, {sql_list(g)}::VARCHAR[], {sql_list(n)}::VARCHAR[])" for t, k, e, g, n in C.MACRO_RULES
) + ")"
EXPAND_SQL = "list_distinct(list_concat({0}, flatten(list_transform({0}, lambda n: " + ALIAS_SQL.format("n") + "))))"
DISTINCT_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _names(spark, sf_dir):
    return articles(spark, sf_dir).withColumns({
        "gain_names": F.array(_nth(NAMES, 0), _nth(NAMES, 5)), "lose_names": F.array(_nth(NAMES, 2), _nth(NAMES, 11)),
    })


NAMES_SQL = f"[{_nth_sql(NAMES, 0)}, {_nth_sql(NAMES, 5)}] AS gain_names, [{_nth_sql(NAMES, 2)}, {_nth_sql(NAMES, 11)}] AS lose_names"


@query("sector_aliases", f"""
WITH {ARTICLES}, n AS (SELECT pos, {NAMES_SQL} FROM articles)
SELECT pos, array_to_string(list_sort({EXPAND_SQL.format('gain_names')}), '|') AS expanded FROM n""")
def sector_aliases(spark, sf_dir):
    expanded = F.array_sort(FC.expand_sectors(F.col("gain_names")))
    return _names(spark, sf_dir).select("pos", F.array_join(expanded, "|").alias("expanded"))


RULE_WORDS = sorted({w for _, _, _, g, n in C.MACRO_RULES for w in g + n})


@query("words_to_sectors", f"""
WITH {ARTICLES}, w AS (SELECT pos, [{', '.join(_nth_sql(RULE_WORDS, k) for k in (0, 1, 4, 9))}] AS words FROM articles),
m AS (SELECT pos, list_transform(words, lambda w: {TO_SECTOR_SQL.format('w')}) AS mapped FROM w)
SELECT pos, array_to_string({DISTINCT_SQL.format('mapped')}, '|') AS sectors FROM m""")
def words_to_sectors(spark, sf_dir):
    words = F.array([_nth(RULE_WORDS, k) for k in (0, 1, 4, 9)])
    return articles(spark, sf_dir).select("pos", F.array_join(FC.words_to_sectors(words), "|").alias("sectors"))


@query("topic_rules", f"""
WITH {ARTICLES}, {RULES_SQL}, t AS (SELECT pos, {topic_sql('lower(summary)')} AS topic FROM articles)
SELECT pos, t.topic, ticker, expected FROM t LEFT JOIN rules ON rules.topic = t.topic""")
def topic_rules(spark, sf_dir):
    from newsloom.functions.text import detect_topic
    rows = articles(spark, sf_dir).select("pos", detect_topic(F.col("summary")).alias("topic"))
    return rows.join(F.broadcast(FC.macro_rules(spark)), "topic", "left").select("pos", "topic", "ticker", "expected")


TICKER_OF = [("CL=F", "click"), ("^TNX", "error"), ("KRW=X", "purchase"), ("^IXIC", "signup"), ("ITA", "view")]
CHECKED = f"""{RULES_SQL}, {PRICES}, {TREND_SQL},
named AS (SELECT CASE ticker {" ".join(f"WHEN '{e}' THEN '{t}'" for t, e in TICKER_OF)} END AS ticker, n_days, pct FROM trend),
ruled AS (SELECT rules.*, n_days, pct, coalesce(n_days, 0) < 2 OR (expected = 'up' AND pct >= -0.5) OR (expected = 'down' AND pct <= 0.5) AS agrees
  FROM rules LEFT JOIN named USING (ticker))"""


def trends(spark, sf_dir):
    """Price trend of the event types under the names of the rule tickers."""
    rows = T.recent_trend(prices(spark, sf_dir))
    name = None
    for ticker, event in TICKER_OF:
        name = F.when(F.col("ticker") == event, ticker) if name is None else name.when(F.col("ticker") == event, ticker)
    return rows.withColumn("ticker", name)


def checked_sql(source, text, gain, lose):
    """CTE ``checked`` with status, topic, message and corrected lists for ``source``."""
    def names(words):
        return f"CASE WHEN len({words}) = 0 THEN 'set()' ELSE '{{' || array_to_string(list_transform({words}, lambda w: '''' || w || ''''), ', ') || '}}' END"

    def mapped(words):
        return f"list_transform(list_sort({words}), lambda w: {TO_SECTOR_SQL.format('w')})"

    return f"""topics AS (SELECT *, {topic_sql(f'lower({text})')} AS topic FROM {source}),
joined AS (SELECT t.*, r.ticker, r.pct, r.agrees, list_sort(list_intersect({EXPAND_SQL.format(gain)}, r.lose)) AS wrong_gain,
  list_sort(list_intersect({EXPAND_SQL.format(lose)}, r.gain)) AS wrong_lose, {mapped('r.gain')} AS to_gain, {mapped('r.lose')} AS to_lose
  FROM topics t LEFT JOIN ruled r ON r.topic = t.topic),
checked AS (SELECT *, CASE WHEN ticker IS NULL THEN 'passed' WHEN len(wrong_gain) > 0 OR len(wrong_lose) > 0 THEN 'failed'
  WHEN NOT agrees THEN 'warning' ELSE 'passed' END AS status,
  CASE WHEN ticker IS NULL THEN '알 수 없는 토픽, 검증 통과' WHEN len(wrong_gain) > 0 OR len(wrong_lose) > 0 THEN
    '경제 논리 오류: 수혜에 잘못 포함된 섹터 ' || {names('wrong_gain')} || ', 주의에 잘못 포함된 섹터 ' || {names('wrong_lose')}
  WHEN NOT agrees THEN '시장 데이터 불일치: ' || ticker || ' 실제 ' || format('{{:.1f}}', pct) || '% 변동 (예상 방향과 다름). 면책 문구 추가 권장.'
  ELSE '''' || topic || ''' 검증 통과' END AS message,
  CASE WHEN ticker IS NOT NULL AND (len(wrong_gain) > 0 OR len(wrong_lose) > 0) THEN {DISTINCT_SQL.format('to_gain')} END AS correct_pos,
  CASE WHEN ticker IS NOT NULL AND (len(wrong_gain) > 0 OR len(wrong_lose) > 0) THEN {DISTINCT_SQL.format('to_lose')} END AS correct_neg FROM joined)"""


TOPIC_PHRASES = [w for _, words in C.TOPIC_WORDS for w in words] + ["새로운 정책"]


@query("fact_check", f"""
WITH {ARTICLES}, {CHECKED}, n AS (SELECT pos, {_nth_sql(TOPIC_PHRASES, 0)} || ' ' || source AS macro, {NAMES_SQL} FROM articles),
{checked_sql('n', 'macro', 'gain_names', 'lose_names')}
SELECT pos, status, topic, message, array_to_string(correct_pos, '|') AS correct_pos, array_to_string(correct_neg, '|') AS correct_neg FROM checked""")
def fact_check(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("macro", F.concat(_nth(TOPIC_PHRASES, 0), F.lit(" "), "source"))
    done = FC.fact_check(rows, F.col("macro"), F.col("gain_names"), F.col("lose_names"), trends(spark, sf_dir))
    return done.select(
        "pos", "fact_check.status", "fact_check.topic", "fact_check.message",
        F.array_join("fact_check.correct_pos", "|").alias("correct_pos"),
        F.array_join("fact_check.correct_neg", "|").alias("correct_neg"),
    )


def corrected_sql(correct, old):
    names = f"list_filter({correct}, lambda n: list_contains({sql_list(C.SECTORS)}, n))[1:2]"
    return (f"CASE WHEN {correct} IS NOT NULL AND len({names}) > 0 THEN list_transform({names}, lambda n, i: {{'name': n, 'reason':"
            f" CASE WHEN coalesce({old}[i].reason, '') <> '' THEN {old}[i].reason ELSE {sql_text(C.DEFAULT_REASON)} END}}) ELSE {old} END")


@query("corrected_sectors", f"""
WITH {VALIDATED}, {CHECKED}, n AS (SELECT pos, fixed3.kept AS gain_list, fixed4.kept AS lose_list, list_transform(fixed3.kept, lambda s: s.name) AS gain_names,
  list_transform(fixed4.kept, lambda s: s.name) AS lose_names, {_nth_sql(TOPIC_PHRASES, 0)} AS macro FROM validated),
{checked_sql('n', 'macro', 'gain_names', 'lose_names')}
SELECT pos, status, {PAIRS_SQL.format(corrected_sql('correct_pos', 'gain_list'))} AS gain, {PAIRS_SQL.format(corrected_sql('correct_neg', 'lose_list'))} AS lose FROM checked""")
def corrected_sectors(spark, sf_dir):
    fixed = R.validate_record(drafts(spark, sf_dir)).withColumn("macro", _nth(TOPIC_PHRASES, 0))
    done = FC.fact_check(
        fixed, F.col("macro"), F.col("slide3_sectors.name"), F.col("slide4_sectors.name"), trends(spark, sf_dir)
    )
    return done.select(
        "pos", "fact_check.status",
        _pairs_text(FC.correct_sectors(F.col("fact_check.correct_pos"), F.col("slide3_sectors"))).alias("gain"),
        _pairs_text(FC.correct_sectors(F.col("fact_check.correct_neg"), F.col("slide4_sectors"))).alias("lose"),
    )
