"""One query per operator over the given tables, with check SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollcall.functions.spread import ensure_checkpoint_dir
from rollcall.llm import (byte_bpe, exact_dedup, filter_audit, ngram_join, nn_descent, packing, personal_data, quality, substring_dedup, token_file,
                          toxicity, url_filter, whitening)
from rollcall.llm.common import table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page by rules and path templates."""
    return url_filter.url_filter(table(spark, folder, "pages"), URL_RULES).drop("share")


_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)

OP10_SQL = f"""
WITH parts AS (
 SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(action, rhost, rpath) AS (VALUES {_RULES_SQL}),
ruled AS (SELECT p.*, r.rule, r.action FROM parts p LEFT JOIN (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
   arg_max(action, length(rhost || rpath) * 1000 + length(rhost)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id) r USING (page_id)),
segs AS (SELECT page_id, host, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM parts),
masked AS (SELECT page_id, host, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS s FROM segs),
node AS (SELECT page_id, host, i - 1 AS depth, s[i] AS seg, CASE WHEN i = 1 THEN '' ELSE s[i - 1] END AS before
 FROM (SELECT page_id, host, s, unnest(range(1, len(s) + 1)) AS i FROM masked)),
wide AS (SELECT host, depth, before FROM node WHERE seg <> '*' GROUP BY 1, 2, 3 HAVING count(DISTINCT seg) > 32),
tok AS (SELECT n.page_id, n.depth, CASE WHEN w.host IS NOT NULL THEN '*' ELSE n.seg END AS seg
 FROM node n LEFT JOIN wide w ON n.host = w.host AND n.depth = w.depth AND n.before = w.before),
lists AS (SELECT page_id, list(seg ORDER BY depth) AS s, max(CASE WHEN seg <> '*' THEN depth END) AS last FROM tok GROUP BY 1),
shapes AS (SELECT page_id, '/' || array_to_string(s, '/') AS template,
  '/' || array_to_string(CASE WHEN last IS NULL THEN s ELSE s[1:last] || ['*'] || s[last + 2:] END, '/') AS parent FROM lists),
pg AS (SELECT r.*, coalesce(template, '/') AS template, coalesce(parent, '/') AS parent,
  CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM ruled r LEFT JOIN shapes USING (page_id)),
one AS (SELECT host, parent, template, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS b FROM pg GROUP BY 1, 2, 3),
pooled AS (SELECT *, (sum(n) OVER (PARTITION BY host, parent))::BIGINT AS pn, (sum(b) OVER (PARTITION BY host, parent))::BIGINT AS pb FROM one),
br AS (SELECT *, CASE WHEN n = 0 OR (b * pn - pb * n)::DOUBLE * (b * pn - pb * n) <= 1.96e0 * 1.96e0 * n::DOUBLE * pb * (pn - pb)
  THEN parent ELSE template END AS branch FROM pooled),
shares AS (SELECT host, template, (mb + 4e0 * ((tb + 4e0 * ((gb + 4e0 * 0.5e0) / (gn + 4e0))) / (tn + 4e0))) / (mn + 4e0) AS share FROM (
 SELECT host, template, (sum(n) OVER (PARTITION BY host, branch))::BIGINT AS mn, (sum(b) OVER (PARTITION BY host, branch))::BIGINT AS mb,
  (sum(n) OVER (PARTITION BY template))::BIGINT AS tn, (sum(b) OVER (PARTITION BY template))::BIGINT AS tb,
  (sum(n) OVER ())::BIGINT AS gn, (sum(b) OVER ())::BIGINT AS gb FROM br))
SELECT page_id, pg.host, path, rule, coalesce(action, CASE WHEN share > 0.5e0 THEN 'block' ELSE 'allow' END) AS verdict, pg.template
FROM pg JOIN shares ON pg.host = shares.host AND pg.template = shares.template
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": OP10_SQL}


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Equal texts of the documents; the largest doc_id of each group stays."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


OP3_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES["op3_exact_dedup"] = op3_exact_dedup
ORACLE["op3_exact_dedup"] = OP3_SQL


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior quality of every document; rejected below one half."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES["op6_quality"] = op6_quality


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return byte_bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES["op7_byte_bpe"] = op7_byte_bpe


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op8_packing"] = op8_packing


def op1_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Token-id file of all documents, written and read back."""
    target = f"{ensure_checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    token_file.write_token_file(table(spark, folder, "documents"), target,
                                public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_file.read_token_file(spark, target)


QUERIES["op1_token_file"] = op1_token_file


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.ngram_components(table(spark, folder, "documents"), n=4, percent=85)


QUERIES["op9_ngram_join"] = op9_ngram_join


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that an earlier document has in a string of 50 bytes."""
    return substring_dedup.repeats(table(spark, folder, "documents"), length=50)


QUERIES["op5_substring_dedup"] = op5_substring_dedup


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES["op4_toxicity"] = op4_toxicity


def op2_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nn_descent.nearest(table(spark, folder, "embeddings"))


QUERIES["op2_nn_descent"] = op2_nn_descent


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove in every order, per language."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < d.doc_id THEN 16 ELSE 0 END AS mask
 FROM d LEFT JOIN (SELECT t AS ft, min(doc_id) AS first FROM d GROUP BY 1) ON t = ft LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
 FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS seen FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INTEGER AS step, bit,
  sum(CASE WHEN mask & (seen | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & seen <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
 FROM f, (SELECT filter_order, step, bit::INTEGER AS bit, seen::INTEGER AS seen FROM s) GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

QUERIES["op12_filter_audit"] = op12_filter_audit
ORACLE["op12_filter_audit"] = OP12_SQL


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on at most 32 whitened components."""
    return whitening.components(table(spark, folder, "embeddings"), "vec_id", "embedding")


QUERIES["op13_whitening"] = op13_whitening


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: strict forms and what their contexts lead to."""
    return personal_data.digests(personal_data.find(table(spark, folder, "documents")))


QUERIES["op11_personal_data"] = op11_personal_data
