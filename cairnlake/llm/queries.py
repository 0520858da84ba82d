"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .exactdedup import exact_groups
from .linededup import dedup_lines
from .mix import mix
from .ngramjoin import jaccard_components
from .packing import pack_documents
from .pii import digest, find_personal_data
from .quality import score_documents
from .tokencount import count_tokens
from .tokens import ALONE
from .topk import exact_top_k
from .urlfilter import judge_urls

TOKENIZER = "word_bpe_49k.json"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), memory=ALONE)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, the removed ones (numbers from 0, comma-joined) and the SHA-256 of what is left of its text."""
    clean = dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select(
        "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2(text_or_empty(), 256).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, and importing this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix, op2_exact_top_k, op3_url_filter, op4_packing, op5_quality, op6_line_dedup, op7_exact_dedup, op8_token_counts, op9_personal_data, op10_ngram_join, pipeline)
    return {f.__name__: f for f in own}


SQL = {
    "op1_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight, 2 * CAST(source_size AS DOUBLE) AS cap,
  CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1), cap)) AS target FROM l),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e""",
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(CASE WHEN len(q.v) = 0 OR len(x.v) = 0 THEN 0 ELSE list_dot_product(q.v, x.v) END AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""",
    "op3_url_filter": r"""
WITH rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(action, rhost, rpath)),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
m AS (SELECT p.*, r.action, r.rhost || r.rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1""",
    "op6_line_dedup": r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT doc_id, line, md5(s) AS h, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words FROM s WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
b AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS after, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY line) - words AS BIGINT) AS before FROM l),
w AS (SELECT doc_id, line, max(line) OVER run AS last, sum(words) OVER run AS n, md5(array_to_string(list(h) OVER run, '')) AS content
    FROM b WINDOW run AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION SELECT doc_id, min(line) OVER run, line, sum(words) OVER run, md5(array_to_string(list(h) OVER run, ''))
    FROM b WINDOW run AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, first_value(doc_id) OVER o AS d1, first_value(last) OVER o AS last1, row_number() OVER o AS n1 FROM w WHERE n >= 50 WINDOW o AS (PARTITION BY content ORDER BY doc_id, line)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(line, last)) AS line FROM v WHERE n1 > 1 AND (doc_id <> d1 OR line > last1)),
f AS (SELECT s.doc_id, s.line, s.s, CASE WHEN l.line IS NOT NULL THEN g.line IS NOT NULL END AS own FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.line = l.line LEFT JOIN g ON s.doc_id = g.doc_id AND s.line = g.line),
x AS (SELECT *, coalesce(own, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)
  AND coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false)) AS gone FROM f),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE gone) AS removed_lines FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed_lines, '') AS removed_lines,
  sha256(coalesce(kept.text, '')) AS text_sha256 FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM c GROUP BY node) r ON r.node = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
