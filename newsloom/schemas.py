"""Explicit schemas (Spark DDL) of all landed and exchanged data."""

ARTICLE = (
    "id string, title string, summary string, url string, published_at timestamp, source string,"
    " tickers array<string>"
)
SECTOR_LIST = "array<struct<name:string,reason:string>>"
SLIDES = (
    f"slide2_facts array<string>, slide2_source string, slide3_sectors {SECTOR_LIST}, slide3_fact string,"
    f" slide4_sectors {SECTOR_LIST}, slide4_fact string, slide5_summaries array<string>, slide5_watch_point string"
)
DRAFT = f"hook_title string, one_line string, sources array<string>, image_keyword string, {SLIDES}"
INNER = "struct<" + SLIDES.replace(" array", ":array").replace(" string", ":string").replace(", ", ",") + ">"
SCRIPT = (
    "issue_id string, hook_title string, one_line string, sources array<string>, image_keyword string,"
    f" inner {INNER}, from_fallback boolean, validation_issues array<string>,"
    " fact_check struct<status:string,topic:string,message:string,correct_pos:array<string>,correct_neg:array<string>>,"
    " extra_disclaimer string, from_cache boolean"
)
FEED_ENTRY = (
    "title string, link struct<_VALUE:string,_href:string>, summary string, description string, published string, pubDate string, updated string"
)
API_ARTICLE = "headline string, summary string, url string, datetime bigint, source string"
PATTERN = "id string, source_url string, type string, token string, description string, examples array<string>"
PRICE = "ticker string, date date, close double"
PICTURE = "id bigint, tags string, imageWidth int, imageHeight int, downloads bigint, largeImageURL string"
CANDIDATE_METRICS = (
    "struct<followers:bigint,likes:bigint,comments:bigint,engagement_rate:double,subscribers:bigint,views:bigint,"
    "view_ratio:double,title:string>"
)
CANDIDATE = f"url string, platform string, account string, metrics {CANDIDATE_METRICS}, reason string"

