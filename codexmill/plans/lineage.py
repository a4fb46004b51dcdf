"""Registered queries: lineage of documents cut into lines, with breaks that follow from lengths of texts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.operators import lineage
from codexmill.plans.catalogue import _t
from codexmill.registry import query

_BASE = """a AS (SELECT coalesce(source, 'none') AS source, doc_id, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT source, doc_id, n, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM a),
d AS (SELECT *, source || '/' || doc_id AS key, 'p' || doc_id AS parent, n % 3 > 0 AS indexable FROM a WHERE n % 19 > 0),
c AS (SELECT *, 'p' || doc_id || '__' || i AS key FROM l WHERE n % 7 > 0),
r AS (SELECT 'r' || doc_id || '_' || i AS key, CASE WHEN length(line) % 11 = 0 THEN 'ghost' || doc_id ELSE 'p' || doc_id || '__' || i END AS chunk, NULL::VARCHAR AS parent FROM l WHERE n % 7 > 0 AND length(line) % 9 > 0
  UNION ALL SELECT 'w' || doc_id, NULL::VARCHAR, 'p' || doc_id FROM a WHERE n % 5 = 0),
nodes AS (SELECT 'raw' AS kind, source || '/' || doc_id AS key FROM a UNION SELECT 'document', key FROM d UNION SELECT 'parent', parent FROM d WHERE n % 13 > 0 UNION SELECT 'chunk', key FROM c UNION SELECT 'row', key FROM r),
edges AS (SELECT 'raw' AS fk, key AS f, 'document' AS tk, key AS t FROM d UNION SELECT 'document', key, 'parent', parent FROM d UNION SELECT 'parent', 'p' || doc_id, 'chunk', key FROM c
  UNION SELECT 'chunk', chunk, 'row', key FROM r WHERE chunk IS NOT NULL UNION SELECT 'parent', parent, 'row', key FROM r WHERE chunk IS NULL)"""


def _artefacts(spark, d):
    a = _t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("document_id"), F.col("doc_id").cast("string").alias("block_id"), F.coalesce("text", F.lit("")).alias("t"))
    a = a.withColumn("n", F.length("t")).withColumn("parent_id", F.concat(F.lit("p"), "block_id"))
    lines = a.select("block_id", "n", "parent_id", F.posexplode(F.split("t", "\n")).alias("i", "line")).where("n % 7 > 0").withColumn("chunk_id", F.concat("parent_id", F.lit("__"), (F.col("i") + 1).cast("string")))
    documents = a.where("n % 19 > 0").select("document_id", "block_id", "parent_id", (F.col("n") % 3 > 0).alias("indexable"))
    ghost = F.when(F.length("line") % 11 == 0, F.concat(F.lit("ghost"), "block_id")).otherwise(F.col("chunk_id"))
    rows = lines.where(F.length("line") % 9 > 0).select(F.concat(F.lit("r"), "block_id", F.lit("_"), (F.col("i") + 1).cast("string")).alias("row_id"), ghost.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"))
    rows = rows.unionAll(a.where("n % 5 = 0").select(F.concat(F.lit("w"), "block_id"), F.lit(None).cast("string"), "parent_id"))
    return a.select("document_id", "block_id"), documents, a.where("n % 19 > 0 AND n % 13 > 0").select("parent_id"), lines.select("chunk_id", "parent_id"), rows


@query(f"""WITH {_BASE}, led AS (SELECT DISTINCT tk AS kind, t AS key FROM edges JOIN nodes ON fk = kind AND f = key), held AS (SELECT DISTINCT fk AS kind, f AS key FROM edges JOIN nodes ON tk = kind AND t = key),
ends AS (SELECT fk AS kind, f AS key FROM edges UNION SELECT tk, t FROM edges)
SELECT 'missing' AS problem, kind, key FROM ends ANTI JOIN nodes USING (kind, key)
UNION ALL SELECT 'orphan', kind, key FROM nodes ANTI JOIN led USING (kind, key) WHERE kind <> 'raw'
UNION ALL SELECT 'barren', kind, key FROM nodes ANTI JOIN held USING (kind, key) WHERE kind <> 'row' AND NOT (kind = 'document' AND key IN (SELECT key FROM d WHERE NOT indexable))""")
def lineage_breaks(spark, d):
    parts = _artefacts(spark, d)
    return lineage.breaks(lineage.nodes(*parts), lineage.edges(*parts), parts[1])


@query(f"""WITH RECURSIVE {_BASE}, seeds AS (SELECT 'document' AS kind, key FROM d WHERE doc_id % 100 = 0 UNION SELECT 'row', key FROM r WHERE chunk LIKE 'ghost%00'),
down AS (SELECT kind AS sk, key AS s, kind, key, 0 AS distance FROM seeds UNION SELECT sk, s, tk, t, distance + 1 FROM down JOIN edges ON fk = kind AND f = key),
up AS (SELECT kind AS sk, key AS s, kind, key, 0 AS distance FROM seeds UNION SELECT sk, s, fk, f, distance - 1 FROM up JOIN edges ON tk = kind AND t = key)
SELECT DISTINCT sk AS seed_kind, s AS seed_key, kind, key, distance FROM (SELECT * FROM down UNION SELECT * FROM up)""")
def lineage_traces(spark, d):
    """Both ways from the blocks of every hundredth document, and from rows whose chunk does not exist."""
    parts = _artefacts(spark, d)
    blocks = parts[1].where(F.col("block_id").cast("long") % 100 == 0).select(F.lit("document").alias("kind"), lineage.block_key().alias("key"))
    stray = parts[4].where("chunk_id LIKE 'ghost%00'").select(F.lit("row").alias("kind"), F.col("row_id").alias("key"))
    return lineage.trace(lineage.edges(*parts), blocks.unionAll(stray))
