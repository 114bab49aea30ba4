"""Readers and writers of landed files. Every reader takes an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from newsloom import constants as C
from newsloom import schemas
from newsloom.functions.text import feed_source, strip, text_or_empty
from newsloom.operators.ranks import with_positions
from newsloom.session import cut_lineage, prepare

# -- articles -----------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.ARTICLE) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True, mode: str = "errorifexists") -> None:
    """One JSON object per line, null fields kept unless told otherwise."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def script_records(spark: SparkSession, path: str, schema: str = schemas.SCRIPT) -> DataFrame:
    """Records of files that hold one JSON array each, or one object or array per line: (s, unread).

    ``s`` is the script, ``unread`` the text of a record (or of the whole array around it) that could not be
    read. A file that begins with a bracket is read as a whole if it is one array (such files are small, one run
    each); everything else goes by lines.
    """
    node = StructType.fromDDL(schema)
    kind = node.simpleString()
    body = F.trim(F.col("value"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")

    def record(script: Column, text: Column) -> Column:
        some = F.lit(False)
        for f in node.fields:
            some = some | F.coalesce(script[f.name].isNotNull(), F.lit(False))
        return F.struct(script.alias("s"), F.when(~some, text).alias("unread"))

    def of_array(text: Column) -> Column:
        found = F.transform(F.from_json(text, f"array<{kind}>"), lambda x: record(x, F.coalesce(F.to_json(x), F.lit("null"))))
        return F.coalesce(found, F.array(F.struct(F.lit(None).cast(kind).alias("s"), text.alias("unread"))))

    by_line = F.flatten(F.transform(lines, lambda x: F.when(F.startswith(F.trim(x), F.lit("[")), of_array(x)).otherwise(
        F.array(record(F.from_json(x, kind), x))
    )))
    one_array = F.startswith(body, F.lit("[")) & ~F.exists(F.slice(lines, 2, 2_147_483_646), lambda x: F.startswith(x, F.lit("[")))
    return spark.read.text(path, wholetext=True).select(F.explode(F.when(one_array, of_array(body)).otherwise(by_line)).alias("r")).select("r.*")


def read_scripts(spark: SparkSession, path: str, schema: str = schemas.SCRIPT) -> DataFrame:
    """The readable scripts of :func:`script_records`."""
    return script_records(spark, path, schema).filter("unread is null").select("s.*")


def unread_scripts(spark: SparkSession, path: str, schema: str = schemas.SCRIPT) -> DataFrame:
    """Quarantine: the text of every record that could not be read."""
    return script_records(spark, path, schema).filter("unread is not null").select("unread")


def write_scripts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scripts as JSON objects, one per line, which ``read_scripts`` and ``read_jsonl`` both read."""
    write_jsonl(df, path, keep_nulls=True, mode=mode)


def select_script(scripts: DataFrame, issue_id: str | int | None) -> DataFrame:
    """Scripts of one issue (compared as text), or all of them."""
    return scripts if issue_id is None else scripts.filter(F.col("issue_id").cast("string") == str(issue_id))


# The named zones of RFC 822 and their offsets.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _feed_time(text: Column) -> Column:
    """Time of a feed entry: RFC 822 or ISO text, null if neither fits."""
    plain = F.regexp_replace(strip(text), r"^[A-Za-z]{3},\s*", "")
    for zone, offset in ZONES.items():
        plain = F.regexp_replace(plain, rf"\s{zone}$", f" {offset}")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(text),
    )


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed feed files: title, description, url, published_at, source, feed, pos, tickers, unread_date.

    The date is the first of the three that can be read. ``unread_date`` has the text of an
    entry whose dates are all unreadable (see ``split_unread``); ``pos`` follows the file.
    Atom links (an attribute) are read as well.
    """
    entries = (
        spark.read.format("xml").option("rowTag", row_tag).schema(schemas.FEED_ENTRY).load(path)
        .withColumns({"feed": F.col("_metadata.file_path"), "pos": F.monotonically_increasing_id()})
    )
    summary = F.when(text_or_empty(F.col("summary")) != "", F.col("summary")).otherwise(F.col("description"))
    dates = ["published", "pubDate", "updated"]
    at = F.coalesce(*[_feed_time(F.col(c)) for c in dates])
    given = F.coalesce(*[F.when(strip(F.col(c)) != "", F.col(c)) for c in dates])
    return entries.select(
        text_or_empty(F.col("title")).alias("title"),
        text_or_empty(summary).alias("description"),
        text_or_empty(F.coalesce("link._VALUE", "link._href")).alias("url"),
        at.alias("published_at"),
        feed_source(F.col("feed")).alias("source"),
        "feed", "pos",
        F.array().cast("array<string>").alias("tickers"),
        F.when(at.isNull(), given).alias("unread_date"),
    )


def split_unread(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries to use (dated or without any date), and those to look at by hand."""
    return feed.filter("unread_date is null").drop("unread_date"), feed.filter("unread_date is not null")


def read_news_api(spark: SparkSession, path: str) -> DataFrame:
    """API responses landed under ``category=<name>``, one JSON array per line."""
    return (
        spark.read.schema(schemas.API_ARTICLE).json(path).withColumn("pos", F.monotonically_increasing_id())
        .select(
            text_or_empty(F.col("headline")).alias("title"),
            text_or_empty(F.col("summary")).alias("description"),
            text_or_empty(F.col("url")).alias("url"),
            F.timestamp_seconds(F.coalesce("datetime", F.lit(0))).alias("published_at"),
            text_or_empty(F.col("source")).alias("source"),
            "category", "pos",
            F.array().cast("array<string>").alias("tickers"),
        )
    )


# -- lists --------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that are neither blank nor comments."""
    line = strip(F.col("value"))
    return spark.read.text(path).select(line.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#")
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("line").alias("url"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list with their numbers from 0: (value, line), by many tasks.

    The files of one write follow each other by their names, those of later writes come after them.
    """
    file = F.col("_metadata.file_name")
    rows = cut_lineage(spark.read.text(path).select(
        "value", F.coalesce(F.nullif(F.regexp_extract(file, r"^part-\d+-([0-9a-f-]{36})", 1), F.lit("")), file).alias("write"),
        F.col("_metadata.file_modification_time").alias("time"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ), "lines")
    writes = rows.groupBy("write").agg(F.min("time").alias("begun"))
    order = [F.col(c) for c in ("begun", "write", "file", "block", "at")]
    return with_positions(rows.join(writes, "write"), order, pos="line").select("value", "line")


def read_accounts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accounts (platform, account, at: their line in the list) and the malformed lines."""
    line = strip(F.col("value"))
    lines = numbered_lines(spark, path).select(line.alias("line"), F.col("line").alias("at")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#")
    )
    value = strip(F.expr("substring(line, 4)"))
    is_post, is_video = F.col("line").startswith("ig:"), F.col("line").startswith("yt:")
    accounts = lines.filter(is_post | is_video).select(
        F.when(is_post, "ig").otherwise("yt").alias("platform"),
        F.when(is_post, F.regexp_replace(value, "^@+", "")).otherwise(value).alias("account"), "at",
    )
    return accounts, lines.filter(~(is_post | is_video)).drop("at")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_patterns(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Patterns of an object with ``patterns`` or of a bare array; nothing if missing or corrupt."""
    names = [part.split()[0] for part in schemas.PATTERN.split(", ")]
    as_struct = ",".join(part.replace(" ", ":", 1) for part in schemas.PATTERN.split(", "))
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"file string, at int, {schemas.PATTERN}")
    docs = (
        spark.read.schema(f"patterns array<struct<{as_struct}>>, {schemas.PATTERN}")
        .option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").json(path)
    )
    bare = F.when(F.coalesce("id", "type", "token").isNotNull(), F.array(F.struct(*names)))
    return (
        docs.withColumn("file", F.col("_metadata.file_path"))
        .select("file", F.posexplode(F.coalesce("patterns", bare)).alias("at", "p"))
        .select("file", "at", "p.*")
    )


def hook_snippet(patterns: DataFrame, limit: int = C.MAX_HOOK_PATTERNS, order=("file", "at")) -> DataFrame:
    """One row with the prompt text of the first hook patterns; empty text without any."""
    example = F.try_element_at(F.col("examples"), F.lit(1))
    line = F.concat(
        F.lit("- "), text_or_empty(F.col("token")), F.lit(": "), text_or_empty(F.col("description")),
        F.when(text_or_empty(example) != "", F.concat(F.lit(' (예: "'), example, F.lit('")'))).otherwise(""),
    )
    first = patterns.filter("type = 'hook'").orderBy(*order).limit(limit).select(F.struct(*order, line.alias("line")).alias("row"))
    lines = F.sort_array(F.collect_list("row")).line
    return first.agg(
        F.when(F.size(lines) > 0, F.concat(F.lit(C.HOOK_HEADER + "\n"), F.array_join(lines, "\n"))).otherwise("")
        .alias("snippet")
    )


# -- social metadata, prices, pictures ------------------------------------------


NODE = "id:string,url:string,title:string,view_count:bigint,entries:string"
CHILDREN = f"filter(from_json(v.entries, 'array<struct<{NODE}>>'), x -> x IS NOT NULL)"


def read_channels(spark: SparkSession, path: str, newest: int = C.MAX_POSTS) -> DataFrame:
    """Videos of landed channel listings: account, subscribers, pos, url, title, view_count.

    Entries are kept as text and unfolded level by level until no node has any, so tabs may
    nest as deep as they like. A node with entries stands for those. Each level is stored, so a task reads one split of one
    level, whatever the size of the listings.
    """
    prepare(spark)
    rows = spark.read.schema("channel string, channel_follower_count bigint, entries string").json(path).withColumn(
        "listing", F.monotonically_increasing_id()
    )
    fields = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in (x.split(":") for x in NODE.split(",")[:-1]))
    level = rows.select(
        "listing", F.col("channel").alias("account"), F.coalesce("channel_follower_count", F.lit(0)).alias("subscribers"),
        F.expr("CAST(array() AS array<int>)").alias("path"), F.expr(f"struct({fields}, entries)").alias("v"),
    )
    leaves = None
    while leaves is None or not level.isEmpty():
        level = cut_lineage(
            level.select("listing", "account", "subscribers", "path", F.posexplode(F.expr(CHILDREN)).alias("i", "child"))
            .select("listing", "account", "subscribers", F.concat("path", F.array("i")).alias("path"), F.col("child").alias("v")),
            "nodes",
        )
        ended = level.filter(F.coalesce(F.size(F.expr(CHILDREN)), F.lit(0)) <= 0)
        leaves = ended if leaves is None else leaves.unionByName(ended)
    place = F.row_number().over(Window.partitionBy("listing").orderBy("path")) - 1
    made = F.when(text_or_empty(F.col("v.id")) != "", F.concat(F.lit(C.VIDEO_URL_PREFIX), "v.id"))
    return leaves.withColumn("pos", place).filter(F.col("pos") < newest).select(
        "account", "subscribers", "pos",
        F.when(text_or_empty(F.col("v.url")) != "", F.col("v.url")).otherwise(made).alias("url"),
        text_or_empty(F.col("v.title")).alias("title"),
        F.coalesce("v.view_count", F.lit(0)).alias("view_count"),
    ).filter("url IS NOT NULL")


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed profiles (account, followers), and their posts: account, followers, pos, shortcode, likes, comments.

    A profile without posts is a profile all the same.
    """
    post = "struct<shortcode:string,likes:bigint,comments:bigint,date:string,is_video:boolean>"
    rows = spark.read.schema(f"account string, followers bigint, posts array<{post}>").json(path)
    posts = rows.select("account", "followers", F.posexplode("posts").alias("pos", "p")).select("account", "followers", "pos", "p.*")
    return rows.select("account", "followers"), posts


def read_prices(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Daily closes; the date bound reaches the parquet scan."""
    prices = spark.read.schema(schemas.PRICE).parquet(path)
    return prices if since is None else prices.filter(F.col("date") >= F.lit(since).cast("date"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Picture search results landed under ``query=/pool=``, one JSON array per line."""
    return (
        spark.read.schema(schemas.PICTURE).json(path)
        .withColumnsRenamed({"imageWidth": "width", "imageHeight": "height"})
    )


# -- discovery output -----------------------------------------------------------


def save_candidates(candidates: DataFrame, path: str, generated_at: str) -> None:
    """Candidates as a table and one envelope row with time and count.

    The envelope stays a single row however many candidates there are.
    """
    candidates.write.option("ignoreNullFields", "true").json(f"{path}/candidates")
    saved = candidates.sparkSession.read.schema(schemas.CANDIDATE).json(f"{path}/candidates")
    saved.agg(F.count("*").alias("count")).select(F.lit(generated_at).alias("generated_at"), "count").write.json(
        f"{path}/envelope"
    )


def append_failures(failures: DataFrame, path: str, at: Column) -> None:
    """Append (time, account, error) lines separated by tabs."""
    failures.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "account", "error").write.mode(
        "append"
    ).option("sep", "\t").csv(path)


def append_urls(urls: DataFrame, path: str) -> None:
    """Append new addresses, one per line, in order of their position over all files."""
    urls.orderBy("pos").select("url").write.mode("append").text(path)
