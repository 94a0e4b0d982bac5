"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from .align import align_tokenizers
from .bpe import encode_documents
from .common import table
from .embed_dedup import near_duplicates
from .html_text import extract_text
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_join import jaccard_components
from .secret_scan import scan_secrets
from .spelling import spelling_variants
from .top_k import top_k
from .url_rules import judge_urls


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: The mixture takes this share of all tokens.
MIX_FRACTION = 0.9


def mix_levels() -> tuple[Column, Column, Column]:
    """Domain (the source's number modulo 4, or ``other``), language and source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (number.try_cast("int") % 4).cast("string"))).otherwise("other")
    return domain, F.col("lang"), F.col("source")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_FRACTION, epochs=2)
    return mixed.select(F.col("id").alias("doc_id"), F.col("l0").alias("domain"), F.col("l1").alias("lang"), F.col("l2").alias("source"), F.col("tokens").alias("n_tokens"), "copies")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.in_training)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (~quality.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_languages(docs, langid.learn(docs, langid.in_training))
    return found.select("doc_id", (~langid.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(table(spark, sf_dir, "documents"), factor=5, counts={"min_chars": 6, "min_count": 5, "drop_every": 199})
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


#: Entries of the URL filter: verdict, host, beginning of the path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_source_mixing": op2_source_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scan": op8_secret_scan,
    "op9_top_k": op9_top_k,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filter": op13_url_filter,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (c.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""

OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN counted c ON e.vec_id = c.a
"""

OP7_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i+3], ' '))))
                      WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s
  FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS i
  FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id <> y.doc_id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * i >= 85 * (n + m - i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON doc_id = a
"""

OP9_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""



def _split_sql(name: str, nodes: str, parent: str, own: str) -> str:
    """CTEs that hand a budget down one level: children by capacity per weight (every weight is 1)."""
    return f"""
{name}_sorted AS (
  SELECT n.*, h.budget,
         coalesce(sum(n.capacity) OVER (PARTITION BY {parent} ORDER BY n.capacity, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         count(*) OVER (PARTITION BY {parent} ORDER BY n.capacity, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
  FROM {nodes} n JOIN {name}_up h USING ({parent})),
{name}_level AS (
  SELECT *, (budget - before) / later AS level, capacity <= (budget - before) / later AS filled FROM {name}_sorted),
{name}_rest AS (
  SELECT {parent}, arg_min(level, capacity) AS common FROM {name}_level WHERE NOT filled GROUP BY {parent}),
{name} AS (
  SELECT l.*, CASE WHEN filled THEN capacity ELSE greatest(0, r.common) END AS share
  FROM {name}_level l LEFT JOIN {name}_rest r USING ({parent}))"""


OP2_SQL = rf"""
WITH docs AS (
  SELECT doc_id, 0 AS root,
         CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
              THEN 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR) ELSE 'other' END AS domain,
         lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
n3 AS (SELECT root, domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 2.0::DOUBLE AS capacity FROM docs GROUP BY ALL),
n2 AS (SELECT root, domain, lang, sum(capacity) AS capacity FROM n3 GROUP BY ALL),
n1 AS (SELECT root, domain, sum(capacity) AS capacity FROM n2 GROUP BY ALL),
a_up AS (SELECT root, sum(tokens) * {MIX_FRACTION}::DOUBLE AS budget FROM n3 GROUP BY root),
{_split_sql("a", "n1", "root", "domain")},
b_up AS (SELECT domain, share AS budget FROM a),
{_split_sql("b", "n2", "domain", "lang")},
c_up AS (SELECT domain, lang, share AS budget FROM b),
{_split_sql("c", "n3", "domain, lang", "source")},
leaf AS (
  SELECT domain, lang, source, CAST(floor(round(share / tokens, 12)) AS BIGINT) AS whole,
         round(share - floor(round(share / tokens, 12)) * tokens, 6) AS rest FROM c WHERE tokens > 0),
placed AS (
  SELECT d.*, whole, rest, md5('mix:' || CAST(whole + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS place
  FROM docs d JOIN leaf USING (domain, lang, source)),
summed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM placed)
SELECT doc_id, domain, lang, source, n_tokens,
       CAST(CASE WHEN n_tokens = 0 THEN 0 ELSE whole + CASE WHEN taken < rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM summed
"""

OP13_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fit AS (
  SELECT page_id, host, path, arg_max(struct_pack(r := h || p, v := verdict), (len(string_split(h, '.')), len(p), verdict = 'block')) AS best
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM fit
"""

ORACLES: dict[str, str] = {
    "op2_source_mixing": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op9_top_k": OP9_SQL,
    "op13_url_filter": OP13_SQL,
}
