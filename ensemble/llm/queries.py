"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


# ---------------------------------------------------------------- 1: n-gram Jaccard join

@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 4: BPE

def vocabulary() -> str:
    """Default vocabulary file (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


# ---------------------------------------------------------------- 7: URL filters

# The rules of the URL query.
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{path}')"


_BY_LENGTH = sorted(URL_RULES, key=len, reverse=True)
URL_SQL = f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, url,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for r in _BY_LENGTH)} END AS rule FROM b)
SELECT page_id, url, host, path, rule,
       CASE WHEN rule IN ({', '.join(f"'{r}'" for r, v in URL_RULES.items() if v == 'block')}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN CAST('0x' || substr(md5(url), 1, 4) AS BIGINT) % 16 = 3 THEN 'block' ELSE 'allow' END AS verdict
FROM c"""


def url_list(pages: DataFrame) -> DataFrame:
    """Block list of whole URLs. The tables have none, so it is derived from ``pages``: the URLs for whose
    md5's first sixteen bits the remainder by 16 is 3."""
    return pages.select("url").filter(F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("long") % 16 == 3)


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, URL_RULES, url_list(pages))


# ---------------------------------------------------------------- 2: quality classifier

@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- 10: language-model scoring

@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_tree

    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 3: benchmark decontamination

@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---------------------------------------------------------------- 8: line dedup

@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 5: personal data

@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find_personal_data(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 6: approximate nearest neighbours

@query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 9: WARC fixity

def _level_sql(below: str) -> str:
    return f"""SELECT archive, up AS node, min(s) AS s, max(e) AS e,
       sha256(concat_ws(':', 'node', min(s), max(e), string_agg(digest, '' ORDER BY node))) AS digest
FROM (SELECT *, node // 16 AS up FROM {below}) GROUP BY archive, up"""


def _leaves_sql(name: str, pages: str) -> str:
    """CTEs that put the records of ``pages`` in place: ``name`` has archive, node, page_id, h, s, e, digest."""
    return f"""{name}r AS (SELECT page_id, CASE WHEN page_id IS NULL THEN -1 ELSE CAST(floor(page_id / 1024.0) AS BIGINT) END AS archive,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id, -1)
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {pages}),
{name}d AS (SELECT archive, page_id, octet_length(encode(record)) AS size, sha256(record) AS h FROM {name}r),
{name}p AS (SELECT *, row_number() OVER w - 1 AS leaf, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM {name}d
      WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, h)),
{name} AS (SELECT archive, leaf AS node, page_id, h, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
       sha256(concat_ws(':', 'leaf', CAST(e - size AS BIGINT), CAST(e AS BIGINT), h)) AS digest FROM {name}p)"""


WARC_SQL = f"""
WITH u AS (SELECT page_id, url, html, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS BIGINT) AS n FROM pages),
copy AS (SELECT page_id, url, CASE WHEN n % 16 = 0 THEN translate(html, 'e', 'a') ELSE html END AS html FROM u WHERE n IS NULL OR n % 256 <> 1
  UNION ALL SELECT page_id, url || '#copy', html FROM u WHERE n % 256 = 2),
{_leaves_sql('l0', 'pages')}, {_leaves_sql('m0', 'copy')},
t1 AS ({_level_sql('l0')}), t2 AS ({_level_sql('t1')}), t3 AS ({_level_sql('t2')}),
top AS (SELECT max(node) AS m FROM l0),
roots AS (SELECT t3.archive, CASE WHEN m = 0 THEN t0.digest WHEN m < 16 THEN t1.digest WHEN m < 256 THEN t2.digest ELSE t3.digest END AS root
  FROM t3 CROSS JOIN top JOIN t2 ON t2.archive = t3.archive AND t2.node = 0 JOIN t1 ON t1.archive = t3.archive AND t1.node = 0
  JOIN l0 AS t0 ON t0.archive = t3.archive AND t0.node = 0),
both_ AS (SELECT coalesce(l0.archive, m0.archive) AS archive, CASE WHEN l0.node IS NULL THEN m0.page_id ELSE l0.page_id END AS page_id,
    coalesce(l0.s, m0.s) AS s, coalesce(l0.e, m0.e) AS e, coalesce(l0.h, m0.h) AS h,
    CASE WHEN m0.node IS NULL THEN 'missing' WHEN l0.node IS NULL THEN 'extra' WHEN l0.digest = m0.digest THEN 'intact' ELSE 'changed' END AS status
  FROM l0 FULL JOIN m0 ON l0.archive = m0.archive AND l0.node = m0.node)
SELECT page_id, archive, s AS record_start, e AS record_end, h AS record_sha256, root, status FROM both_ LEFT JOIN roots USING (archive)"""


@query("op9_warc_fixity", WARC_SQL)
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a written copy of the pages' records, damaged by a fixed rule, against the pages."""
    from . import warc
    from .common import written

    pages = table(spark, sf_dir, "pages")
    return warc.fixity(pages, written(warc.records(warc.damaged(pages)), "replica"))


# ---------------------------------------------------------------- 11: embedding whitening

@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 12: centroid clustering

def _centroids_sql(k: int = 8, rounds: int = 10) -> str:
    dist = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, v, min(struct_pack(d := CAST({dist} AS BIGINT), cluster := cluster)) AS best "
                     f"FROM kept CROSS JOIN c{r} GROUP BY row, v)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT best.cluster AS cluster, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) AS t(i) GROUP BY 1, 2), "
                f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN "
                f"(SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster) AS m USING (cluster))")
    last = rounds
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{', '.join(steps)},
final AS (SELECT vec_id, best.cluster AS cluster, best.d AS distance FROM a{last} JOIN kept USING (row))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM final JOIN c{last} USING (cluster)"""


@query("op12_centroids", _centroids_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 13: sharding

@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(table(spark, sf_dir, "documents"))
