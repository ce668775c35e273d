"""Queries of joins, sets, windows and geometry over the star schema, events and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import geometry as G
from strandloom.plans.catalog import Catalog
from strandloom.session import read

catalog = Catalog()
query = catalog.query


@query(
    """
SELECT l_partkey, l_orderkey, l_linenumber, l_discount, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1
"""
)
def best_hit(spark, directory):
    """The best line of each part by three scores, exact ties by key; a map-side aggregation in place of a sort."""
    order = F.struct("l_discount", "l_quantity", "l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))
    best = read(spark, directory, "lineitem").groupBy("l_partkey").agg(F.max(order).alias("b"))
    return best.select("l_partkey", (-F.col("b.o")).alias("l_orderkey"), (-F.col("b.n")).alias("l_linenumber"), "b.l_discount", "b.l_quantity", "b.l_extendedprice")


@query(
    """
SELECT o_orderkey, n_name, r_name, CASE WHEN c_custkey IS NULL THEN 'no_customer' WHEN n_nationkey IS NULL THEN 'no_nation' ELSE 'mapped' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""
)
def mapped_orders(spark, directory):
    """Orders through a chain of left joins, with where the chain broke."""
    orders = read(spark, directory, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, directory, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, directory, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = read(spark, directory, "region").select("r_regionkey", "r_name")
    chain = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    status = F.when(F.col("c_custkey").isNull(), "no_customer").when(F.col("n_nationkey").isNull(), "no_nation").otherwise("mapped")
    return chain.select("o_orderkey", "n_name", "r_name", status.alias("status"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, directory):
    """Customers that no order names."""
    return read(spark, directory, "customer").select("c_custkey").join(read(spark, directory, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(
    """
SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount, count(*) AS lines FROM lineitem GROUP BY ALL
"""
)
def weighted_coverage(spark, directory):
    """Quantity-weighted mean discount per pair of flags."""
    return read(spark, directory, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.try_divide(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity")), 6).alias("weighted_discount"), F.count("*").alias("lines"))


@query(
    """
SELECT l_suppkey AS key, 'both' AS side FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey, 'both' FROM lineitem WHERE l_returnflag = 'A'
UNION ALL (SELECT l_suppkey, 'returned_only' FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, 'returned_only' FROM lineitem WHERE l_returnflag = 'A')
"""
)
def supplier_sets(spark, directory):
    """Suppliers in both of two sets, or in the first alone."""
    lines = read(spark, directory, "lineitem")
    returned, accepted = (lines.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("key")) for f in "RA")
    return returned.intersect(accepted).withColumn("side", F.lit("both")).unionByName(returned.subtract(accepted).withColumn("side", F.lit("returned_only")))


@query(
    """
SELECT p_partkey, p_size, p_retailprice FROM part p WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))
"""
)
def pareto_parts(spark, directory):
    """Parts that no other part beats in size and price."""
    return G.pareto_front(read(spark, directory, "part"), "p_partkey", "p_size", "p_retailprice")


_POINTS = "WITH a AS (SELECT vec_id, label, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings)"


def _points(spark, directory):
    e = F.col("embedding")
    return read(spark, directory, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * 40).alias(c) for i, c in enumerate("xyz")])


@query(
    _POINTS
    + """
, d AS (SELECT p.vec_id AS residue, 'L' || r.label AS chain, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS d FROM a p, a r WHERE p.label = 0 AND r.label <> 0)
, n AS (SELECT residue, min(d) AS least, list_sort(list_distinct(list(chain) FILTER (d <= 1.0))) AS chains FROM d WHERE d <= 1.6 GROUP BY 1)
SELECT vec_id AS residue, round(least, 6) AS least_distance, coalesce(least <= 1.0, false) AS direct, coalesce(least > 1.0, false) AS second_shell, coalesce(chains, []) AS chains FROM a LEFT JOIN n ON residue = vec_id WHERE label = 0
"""
)
def point_contacts(spark, directory):
    """Points of one kind with their distance to the nearest of the others, by a grid join."""
    points = _points(spark, directory)
    protein = points.where("label = 0").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("residue"), "x", "y", "z")
    rna = points.where("label <> 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label")).alias("chain"), "x", "y", "z")
    return G.contacts(protein, rna, 1.0, 1.6)


@query(
    _POINTS
    + """
, c AS (SELECT label || '/' || (vec_id // 100) AS chain, vec_id, x, y, z FROM a), g AS (SELECT chain, lag(vec_id) OVER w AS before, vec_id AS after, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS gap FROM c WINDOW w AS (PARTITION BY chain ORDER BY vec_id))
SELECT chain, before, after, round(gap, 6) AS gap FROM g WHERE gap > 9
"""
)
def point_gaps(spark, directory):
    """Neighbours along chains of points that lie far apart."""
    chains = _points(spark, directory).select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 100)).alias("chain"), F.col("vec_id").alias("number"), "x", "y", "z")
    return G.chain_breaks(chains, 9.0)


@query()
def superposed_points(spark, directory):
    """RMSD of each label's points, laid over another three of their coordinates."""
    e = F.col("embedding")
    cells = read(spark, directory, "embeddings").select("label", *[e[i].cast("double").alias(c) for i, c in enumerate("xyzuvw")])
    return G.superposed_rmsd(cells, ["label"])


@query(
    """
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL
"""
)
def hourly_events(spark, directory):
    """Events per type and hour, with a field of their JSON properties."""
    events = read(spark, directory, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.sum(k).alias("k"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def order_cube(spark, directory):
    """Orders per priority and status with all subtotals."""
    return read(spark, directory, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS representative, coalesce(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), []) AS langs FROM documents WHERE text IS NOT NULL GROUP BY 1
"""
)
def exact_documents(spark, directory):
    """Documents once per content hash, with their copies and languages."""
    docs = read(spark, directory, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("representative"), F.array_sort(F.collect_set("lang")).alias("langs"))


QUERIES, SQL = catalog.queries, catalog.sql
