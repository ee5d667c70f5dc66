"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, htmltext, langid, minhash, mixing, packing, pigeonhole, pii, secrets, sortmeans, toxicity, vptree, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, probability and draw."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", *(F.col(f"mix_{c}").alias(c) for c in ("topic", "tokens", "weight", "probability", "kept")))


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector, searched exactly."""
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(_table(spark, sf_dir, "documents")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), most=8)


def op12_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.digest(*sortmeans.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, a tree of one branch, formatted and read back; with
    conversation -1, whose texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    told = _table(spark, sf_dir, "conversations").select(*(F.col(f.name).cast(f.dataType) for f in probe.schema)).union(probe)
    messages = chat.chains(told)
    out = chat.digest(chat.format_paths(messages, chat.paths(messages)))
    return out.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def queries() -> dict:
    found = (op1_mixing, op2_vptree, op3_html, op4_pii, op5_pigeonhole, op6_toxicity, op7_minhash, op8_secrets, op9_packing, op10_langid, op11_whitening, op12_sortmeans, op13_chat)
    return {f.__name__: f for f in found}


_LINKED = """
r(id, c) AS (SELECT id, id FROM n UNION SELECT r.id, CASE WHEN l.a = r.c THEN l.b ELSE l.a END FROM r JOIN l ON l.a = r.c OR l.b = r.c),
m AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""

#: All pairs of vectors, and what links reach.
_PIGEONHOLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
n AS (SELECT a AS id FROM l UNION SELECT b FROM l), {_LINKED}
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id OR l.b = e.vec_id) AS BIGINT) AS n_links, coalesce(m.component, e.vec_id) AS component_id, e.vec_id = coalesce(m.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.id = e.vec_id"""

#: Shingle sets, classes of equal sets, links by shared shingles, and what they reach.
_MINHASH_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END AS h FROM w),
k AS (SELECT doc_id, len(h) AS n, md5(array_to_string(list_sort(h), chr(10))) AS d, h FROM s),
c AS (SELECT d, min(doc_id) AS id, arg_min(h, doc_id) AS h, any_value(n) AS n FROM k WHERE n > 0 GROUP BY d),
x AS (SELECT id, n, unnest(h) AS g FROM c),
l AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.g = q.g AND p.id < q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
n AS (SELECT a AS id FROM l UNION SELECT b FROM l), {_LINKED}
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.component, c.id, k.doc_id) AS component_id, k.doc_id = coalesce(m.component, c.id, k.doc_id) AS kept
FROM k LEFT JOIN c ON c.d = k.d AND k.n > 0 LEFT JOIN m ON m.id = c.id"""


#: Lloyd's rounds in full over the table, without any bound; ``{rounds}`` is filled below.
_SORTMEANS_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * e[i]) AS BIGINT) AS x FROM v, range(1, 65) t(i)),
f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v ORDER BY k LIMIT 8),
c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN x USING (r)){rounds}
SELECT v.vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s.h AS centroid_sha256
FROM a10 JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c10 GROUP BY k) s USING (k)"""


def _sortmeans_sql() -> str:
    out = ""
    for t in range(11):
        out += f""",
d{t} AS (SELECT r, k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{t} c USING (i) GROUP BY r, k),
a{t} AS MATERIALIZED (SELECT r, k, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
        if t < 10:
            out += f""",
m{t} AS (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{t} JOIN x USING (r) GROUP BY k, i),
c{t + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (k, i))"""
    return _SORTMEANS_SQL.replace("{rounds}", out)


def _chat_sql() -> str:
    """Digests of the turns themselves; a formatted text is longer than they by its
    marks, by a backslash for each backslash and by one for each control string."""
    marks = sum(map(len, (chat.TURN, chat.TEXT, chat.END)))
    added = " + ".join(["length(s) - length(replace(s, chr(92), ''))", *(f"(length(s) - length(replace(s, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)])
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS s FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || s || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(s) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(s, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({marks} + length(role) + length(s) + {added}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


def oracle_sql() -> dict:
    """SQL for the pair operators, on tables small enough for all pairs, for clustering
    and chat formatting; the others are learned, tokenized or ranked by a float and are
    tested by brute force."""
    return {"op5_pigeonhole": _PIGEONHOLE_SQL, "op7_minhash": _MINHASH_SQL, "op12_sortmeans": _sortmeans_sql(), "op13_chat": _chat_sql()}
