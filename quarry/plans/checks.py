"""Queries over assignments, aligned tables, rules, staged writes and the reports' joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import assigning, constraints
from quarry.plans.registry import SQL_SPACE, query, table
from quarry.sources import responses, sinks
from quarry.storage import fresh_path

_KEY = f"trim(regexp_replace(lower(text), '{SQL_SPACE}', ' ', 'g'))"


@query("""WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, i, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS q FROM v),
s AS (SELECT list(q ORDER BY vec_id) AS c FROM u WHERE vec_id < 10),
f(i, centres, sums, cluster, near) AS (
 SELECT 0::BIGINT, c, list_transform(c, lambda x: NULL::DOUBLE[]), NULL::BIGINT, NULL::DOUBLE FROM s
 UNION ALL
 SELECT i, CASE WHEN m > 0.8 THEN list_append(centres, q) WHEN j <= n THEN centres ELSE list_transform(centres, lambda x, k: CASE WHEN k = j THEN list_transform(total, lambda y: y / sqrt(list_inner_product(total, total))) ELSE x END) END,
  CASE WHEN m > 0.8 THEN list_append(sums, q) WHEN j <= n THEN sums ELSE list_transform(sums, lambda x, k: CASE WHEN k = j THEN total ELSE x END) END,
  CASE WHEN m > 0.8 THEN len(centres) ELSE j - 1 END, near
 FROM (SELECT i, q, centres, sums, n, near, m, list_position(d, m) AS j, CASE WHEN m <= 0.8 AND list_position(d, m) > n THEN list_transform(list_zip(sums[list_position(d, m)], q), lambda z: z[1] + z[2]) END AS total
  FROM (SELECT u.i, u.q, f.centres, f.sums, n, d, list_min(d[1:n]) AS near, list_min(d) AS m
   FROM (SELECT f.i + 1 AS i, f.centres, f.sums, len(list_filter(f.sums, lambda x: x IS NULL)) AS n FROM f) f JOIN u USING (i), LATERAL (SELECT list_transform(f.centres, lambda c: 1 - list_inner_product(c, u.q)) AS d))))
SELECT u.vec_id, CAST(f.cluster AS INTEGER) AS cluster, f.cluster < 10 AS is_seed, round(f.near, 6) + 0.0 AS nearest_seed_dist FROM f JOIN u USING (i)""")
def strategy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in one ordered stream to ten fixed seeds or to clusters they found, with the distance to the nearest seed."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = assigning.online_assignment(vectors, vectors.filter("vec_id < 10"), "vec_id", "embedding", 0.8)
    return found.withColumn("nearest_seed_dist", F.round("nearest_seed_dist", 6) + 0.0)


@query("""WITH a AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN 'seed' ELSE 'new' END AS kind, doc_id % 9 AS seed, lower(source) AS key, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS name FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT key, min(ord) AS first, arg_min(name, ord) AS label FROM a WHERE kind = 'new' GROUP BY key UNION ALL SELECT 'zz', NULL, 'unclassified (model gave no assignment)'),
i AS (SELECT *, 5 + row_number() OVER (ORDER BY first NULLS LAST) AS idx FROM n)
SELECT d.doc_id AS ord, CAST(CASE WHEN a.kind = 'seed' THEN greatest(least(seed - 1, 5), 0) ELSE idx END AS INTEGER) AS cluster_idx, coalesce(a.kind = 'seed', false) AS is_seed, CASE WHEN a.kind = 'seed' THEN NULL ELSE i.label END AS label
FROM documents d LEFT JOIN a ON a.ord = d.doc_id LEFT JOIN i ON i.key = CASE WHEN a.ord IS NULL THEN 'zz' WHEN a.kind = 'new' THEN a.key END""")
def named_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Strategies to six seeds or named new clusters by replayed answers; what no answer assigns has a cluster of its own."""
    docs = table(spark, d, "documents")
    key = F.col("doc_id")
    name = F.when(key % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    answer = F.when(key % 3 == 0, F.concat(F.lit("Seed: "), (key % 9).cast("string"))).otherwise(F.concat(F.lit(" new: "), name, F.lit(" ")))
    answers = docs.filter(key % 7 != 0).select(key.alias("ord"), key.alias("place"), answer.alias("cluster"))
    return assigning.named_assignment(docs.select(key.alias("ord")), answers, 6)


@query("""SELECT doc_id // 25 AS batch, md5(string_agg('[' || doc_id || '] ' || coalesce(source, ''), chr(10) ORDER BY doc_id)) AS prompt FROM documents GROUP BY 1""")
def assignment_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("source", F.lit("")).alias("strategy"))
    return assigning.batches(docs).withColumn("prompt", F.md5("prompt"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey AS k, o_totalprice AS p FROM orders),
r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey AS k, CASE WHEN o_orderkey % 400 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders))
SELECT coalesce(l.position, r.position) AS position, l.k AS left_key, r.k AS right_key, l.p AS left_price, r.p AS right_price FROM l FULL JOIN r ON l.position = r.position WHERE (l.k, l.p) IS DISTINCT FROM (r.k, r.p)""")
def misaligned_orders(spark: SparkSession, d: str) -> DataFrame:
    """Where two listings of the orders differ by position: changed prices, and the last day missing on one side."""
    left = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    last = left.agg(F.max("o_orderdate")).first()[0]
    right = left.filter(F.col("o_orderdate") < F.lit(last)).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 400 != 0, F.col("o_totalprice")))
    found = constraints.misaligned(left, right, ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return found.select("position", *[F.col(f"{side}.{c}").alias(f"{side}_{name}") for c, name in (("o_orderkey", "key"), ("o_totalprice", "price")) for side in ("left", "right")])


@query(f"""WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents WHERE lang = 'en' AND len(list_filter(regexp_split_to_array(text, '{SQL_SPACE}'), lambda w: w <> '')) <= 300),
f AS (SELECT key, min(doc_id) AS doc_id FROM k WHERE key <> '' GROUP BY key) SELECT doc_id, md5(key) AS key FROM f ORDER BY doc_id LIMIT 60 OFFSET 20""")
def seed_window(spark: SparkSession, d: str) -> DataFrame:
    """Places 20 to 79 of the short English texts, each text once, from a scan that ends when it has them."""
    docs = table(spark, d, "documents").withColumn("key", scalar.norm(F.col("text")))
    keep = (F.col("lang") == "en") & (scalar.word_count(F.col("text")) <= 300) & (F.col("key") != "")
    return constraints.first_passing(docs, "doc_id", keep, 20, 60, "key").withColumn("key", F.md5("key"))


@query("SELECT md5(coalesce(text, '')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return constraints.duplicates(table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("key")), "key")


@query(f"""WITH k AS (SELECT {_KEY} AS key, doc_id % 2 AS half FROM documents) SELECT md5(key) AS key FROM k GROUP BY key HAVING count(DISTINCT half) = 2""")
def shared_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that two sets, which should have none in common, both hold."""
    docs = table(spark, d, "documents")
    found = constraints.shared(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), scalar.norm(F.col("text")))
    return found.select(F.md5("key").alias("key"))


@query("""SELECT 'short enough' AS rule, count(*) AS n, min(doc_id::VARCHAR) AS low, max(doc_id::VARCHAR) AS high FROM documents WHERE NOT coalesce(n_chars <= 5000, false) HAVING count(*) > 0
UNION ALL SELECT 'known source', count(*), min(doc_id::VARCHAR), max(doc_id::VARCHAR) FROM documents WHERE NOT coalesce(source <> 'src3', false) HAVING count(*) > 0""")
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that documents break, seen in the pass that writes them."""
    watch = constraints.Watch(table(spark, d, "documents"), "doc_id", {"short enough": F.col("n_chars") <= 5000, "known source": F.col("source") != "src3", "numbered": F.col("doc_id") >= 0})
    watch.rows.write.parquet(fresh_path(spark, "watched"))
    return spark.createDataFrame([(rule, *told) for rule, told in watch.broken().items()], "rule string, n bigint, low string, high string")


@query("""SELECT 'samples' AS name, count(*) AS rows, sum(quality) AS quality FROM labels UNION ALL SELECT 'index', count(*), NULL FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def published_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark's tables written aside, verified and renamed, its manifest beside what the tables hold."""
    samples = table(spark, d, "labels")
    index = constraints.restricted(table(spark, d, "documents").select("doc_id", "lang", "source"), samples, "doc_id")
    target = fresh_path(spark, "benchmark")
    manifest = sinks.publish({"samples": samples, "index": index}, target, sources=(d,))
    quality = spark.read.parquet(f"{target}/samples").agg(F.lit("samples").alias("name"), F.sum("quality").alias("quality"))
    counts = spark.createDataFrame([(name, told["rows"]) for name, told in manifest.items()], "name string, rows bigint")
    return counts.join(quality, "name", "left")


@query("""SELECT doc_id, lang, NULL::VARCHAR AS clarity FROM documents WHERE n_chars > 1000""")
def replaced_split(spark: SparkSession, d: str) -> DataFrame:
    """A dataset's split after its second publication, a column it does not have null."""
    docs, root = table(spark, d, "documents"), fresh_path(spark, "dataset")
    for part in (docs, docs.filter("n_chars > 1000")):
        sinks.replace_split(part, root, "train", "doc_id", ["doc_id", "lang", "clarity"])
    return sinks.read_split(spark, root, "train", "doc_id bigint, lang string, clarity string")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT o_custkey::VARCHAR AS request, CAST(place AS INTEGER) AS place, 'P' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS tries
FROM o WHERE o_custkey % 7 <> 0""")
def recorded_searches(spark: SparkSession, d: str) -> DataFrame:
    """Papers of recorded searches, one a customer: some were asked twice, some never answered, and other endpoints are not read."""
    orders, path = table(spark, d, "orders"), fresh_path(spark, "responses")
    paper = F.struct("o_orderkey", F.to_json(F.struct(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").alias("year"))).alias("json"))
    found = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(paper)).alias("p"))
    body = F.concat(F.lit('{"data":['), F.array_join("p.json", ","), F.lit("]}"))
    key = F.col("c")
    statuses = F.when(key % 7 == 0, F.array(F.lit(500), F.lit(503), F.lit(429))).when(key % 5 == 0, F.array(F.lit(429), F.lit(200))).otherwise(F.array(F.lit(200)))
    tries = found.select(key.cast("string").alias("request"), body.alias("__body"), F.posexplode(statuses).alias("attempt", "status")).withColumn("body", F.when(F.col("status") == 200, F.col("__body")).otherwise("busy"))
    responses.record(tries.withColumn("endpoint", F.lit("search")), path)
    responses.record(tries.withColumns({"endpoint": F.lit("total"), "body": F.lit('{"total": 3}')}), path)
    settled = responses.settled(responses.recorded(spark, path, "search"), 3)
    told = responses.papers(settled)
    return told.join(settled.select("request", "tries"), "request").select("request", "place", "paper.title", "paper.year", "tries")
