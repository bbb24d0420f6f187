"""The queries on `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import clustering, topk, whitening
from tidemark.llm.common import table
from tidemark.llm.registry import query


@query()
def op11_embedding_whitening(spark, sf_dir):
    """Every vector on the first eight whitened components of the exact covariance."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), factor=1024, shift=100_000, components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def whole(where: str = "") -> str:
    return f"""SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{where}"""


def lloyd_sql(k: int, rounds: int) -> str:
    parts = [f"v AS MATERIALIZED ({whole(' AND len(embedding) = 64')})",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x FROM v QUALIFY k < {k})"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x
    FROM (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (k)"""


@query(lloyd_sql(40, 5))
def op12_centroid_clustering(spark, sf_dir):
    """Five rounds of exact clustering into 40 clusters, and every vector's cluster after them."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"), dims=64, factor=256, k=40, rounds=5, seed="2")


@query(f"""WITH v AS MATERIALIZED ({whole()}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5""")
def op13_top_k_search(spark, sf_dir):
    """The five rows of the largest inner product with every 50th row."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, factor=256, k=5)
