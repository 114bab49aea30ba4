"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    byte_bpe,
    embedding_links,
    jaccard,
    katz,
    language,
    line_dedup,
    merkle,
    packing,
    token_files,
    topk,
    toxicity,
    url_filter,
    whitening,
)
from newsloom.llm.registry import held_out, query, read

# Fixed values of the query: prefix rules, and host words whose pages make up the URL list.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UNWANTED = "(^|[.-])(casino|poker|bet|pills|porn|xxx)([.-]|$)"

OP2_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), keyed AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www|m)[.]', '') <> ''
    THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') END AS url_key FROM parts
), listed AS (
  SELECT DISTINCT url_key FROM keyed WHERE regexp_matches(host, '{UNWANTED}') AND url_key IS NOT NULL
), rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), ranked AS (
  SELECT page_id, host, path, url_key, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM keyed LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN url_key IN (SELECT url_key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(url_key IN (SELECT url_key FROM listed), FALSE) AS listed
FROM ranked WHERE n = 1
"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of all pages on hosts with an unwanted word."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.filter(host.rlike(UNWANTED)).select(url_filter.canonical(host, path).alias("url_key"))
    return url_filter.filter_urls(pages, listed, RULES)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op6_exact_top_k", OP6_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.fresh_folder(docs)
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, vocabulary=49_408)
    return token_files.read_token_files(files)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=1 << 20)


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = language.learn(docs.filter("not held_out"))
    return language.predict(docs, profiles, keep=["doc_id", "held_out"])


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = toxicity.learn(docs.filter("not held_out"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN roots ON roots.a = vec_id
"""


@query("op10_embedding_links", OP10_SQL)
def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.embedding_links(read(spark, sf_dir, "embeddings"))


MIN_WORDS = 5

OP4_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words
  FROM split WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), runs AS (
  {" UNION ALL ".join(f'''SELECT doc_id, q, {n} AS n, string_agg(line, chr(10)) OVER w AS run FROM lines
    WINDOW w AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)
    QUALIFY sum(words) OVER w >= {MIN_WORDS} AND count(*) OVER w = {n}''' for n in range(1, MIN_WORDS + 1))}
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, q) AS place FROM runs
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM ordered o JOIN lines l ON l.doc_id = o.doc_id AND l.q >= o.q AND l.q < o.q + o.n WHERE place > 1
), kept AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.i) FILTER (g.i IS NULL) AS text, count(g.i) AS removed_lines
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id
)
SELECT doc_id, CASE WHEN removed_lines = 0 THEN d.text WHEN regexp_matches(kept.text, '[^ \\t\\n\\x0B\\f\\r]') THEN kept.text ELSE '' END AS text,
  coalesce(removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<first_line:int,lines:int>>")), F.lit(0).cast("long"), lambda n, r: n + r["lines"])
    return line_dedup.dedup_lines(docs, MIN_WORDS).select("doc_id", "text", removed.alias("removed_lines"))


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON roots.a = doc_id
"""


@query("op9_jaccard_join", OP9_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), 4, 85)


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
GROUP_LEVELS, TOP_LEVELS = 6, 3  # of the SQL: up to 16**6 rows a source, 16**3 sources


def _leaf_sql(text: str) -> str:
    fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of the nodes name0..name{levels} by (source, pos), and of what stands beside each of them."""
    out = []
    for k in range(levels):
        beside = "string_agg(d, '') OVER (PARTITION BY source, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_beside{k} AS (SELECT source, pos, n,
  coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}
), {name}{k + 1} AS (SELECT source, pos // 16 AS pos, (n + 15) // 16 AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d FROM {name}{k} GROUP BY source, pos // 16, n)""")
    return ", ".join(out)


def _fold_sql(start: str, name: str, levels: int, pos: str, source: str) -> str:
    out, last = [], start
    for k in range(levels):
        out.append(f"""{name}_fold{k} AS (SELECT f.* REPLACE (CASE WHEN b.n > 1 THEN sha256(b.l || f.now || b.r) ELSE f.now END AS now,
  CASE WHEN b.n > 1 THEN f.proof || b.l || b.r ELSE f.proof END AS proof)
  FROM {last} f JOIN {name}_beside{k} b ON b.source IS NOT DISTINCT FROM {source} AND b.pos = {pos} // {16**k})""")
        last = f"{name}_fold{k}"
    return ", ".join(out)


OP11_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN doc_crc % 5 = 0 THEN changed ELSE leaf END AS now, '' AS proof,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    {_leaf_sql(f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}')")} AS changed, DOC_CRC AS doc_crc FROM documents)
), own0 AS (SELECT source, pos, n, leaf AS d FROM leaves), {_tree_sql("own", GROUP_LEVELS)},
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM own{GROUP_LEVELS}),
top0 AS (SELECT NULL::VARCHAR AS source, place AS pos, n, subroot AS d FROM subroots), {_tree_sql("top", TOP_LEVELS)},
placed AS (SELECT l.*, s.subroot, s.place FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source),
{_fold_sql("placed", "own", GROUP_LEVELS, "f.pos", "f.source")},
{_fold_sql(f"own_fold{GROUP_LEVELS - 1}", "top", TOP_LEVELS, "f.place", "NULL")}
SELECT doc_id, leaf, subroot, top{TOP_LEVELS}.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = top{TOP_LEVELS}.d AS verified
FROM top_fold{TOP_LEVELS - 1}, top{TOP_LEVELS}
"""


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: bit by bit over the bytes of a short ASCII text."""
    byte = f"list_transform(string_split({text}, ''), lambda c: ascii(c))"
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    bits = f"list_reduce(list_concat([xor(acc, b)::UBIGINT], range(8)::UBIGINT[]), lambda c, i: {step})"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], ({byte})::UBIGINT[]), lambda acc, b: {bits}), 4294967295)"


OP11_SQL = OP11_SQL.replace("DOC_CRC", crc32_sql("CAST(doc_id AS VARCHAR)"))


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in LEAF_FIELDS}
    changed = fields | {"text": F.translate("text", url_filter.UPPER, url_filter.LOWER)}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    manifest = merkle.build(docs, list(fields.values()), id_col="doc_id", group_col="source", changed=list(changed.values()), where=tampered)
    return manifest.check().withColumnRenamed("id", "doc_id")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = whitening.pack(read(spark, sf_dir, "embeddings"))
    model = whitening.fit(tiles)
    if model is None or not len(model.variances):
        return spark.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    rows = model.whiten(tiles).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model.identity_error(tiles)).alias("identity_error"),
    )


@query("op13_katz_scores")
def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scores = katz.score(docs, ~aside, order=3)
    return scores.select("doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
