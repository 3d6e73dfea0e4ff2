"""Queries: joins, aggregates, information measures and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders, joins, neighbors, stats
from .registry import EM, PX, pixels, query, r6, table, vectors

_D2 = "list_sum(list_transform(range(1, 65), lambda i: pow(q.v[i] - p.v[i], 2)))"


def _pairs(spark, d):
    df = vectors(spark, d)
    q = df.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return q, df.select(F.col("id").alias("p"), F.col("v").alias("pv"))


@query("SELECT e.vec_id AS id, label, quality FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id")
def zip_join(spark, d):
    return joins.zipped(vectors(spark, d).select("id", "label"), table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"))


@query(EM + f"SELECT q, p, round(d2, 5) AS d2, r::INT AS rank FROM (SELECT q.id AS q, p.id AS p, {_D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, p.id) AS r FROM e q, e p WHERE q.id % 50 = 0) WHERE r <= 5")
def k_nearest(spark, d):
    return joins.nearest(*_pairs(spark, d), 5).select("q", "p", F.round("d2", 5).alias("d2"), "rank")


@query(EM + f"SELECT q, p FROM (SELECT q.id AS q, p.id AS p, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, p.id) AS r FROM e q, e p WHERE q.id % 50 = 0) WHERE r = 1")
def nearest_neighbor(spark, d):
    return joins.nearest(*_pairs(spark, d), 1).select("q", "p")


@query(EM + f"SELECT q, p, round(d2, 5) AS d2, r::INT AS rank FROM (SELECT q.id AS q, p.id AS p, {_D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, p.id) AS r FROM e q, e p WHERE q.id % 50 = 0) WHERE r <= 3")
def tree_nearest_vectors(spark, d):
    return neighbors.nearest_by_tree(*_pairs(spark, d), 3).select("q", "p", F.round("d2", 5).alias("d2"), "rank")


@query("WITH x AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS a, (o_custkey % 1000)::DOUBLE AS b FROM orders), j AS (SELECT q.id AS q, p.id AS p, (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) AS d2 FROM x q, x p WHERE q.id % 50 = 0) SELECT q, p, round(d2, 5) AS d2, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS r FROM j) WHERE r <= 5")
def tree_nearest_orders(spark, d):
    """Orders near in price and customer: few dimensions, where a tree asks few points."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("p"), F.array(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 1000).cast("double")).alias("pv"))
    return neighbors.nearest_by_tree(p.filter("p % 50 = 0").toDF("q", "qv"), p, 5).select("q", "p", F.round("d2", 5).alias("d2"), "rank")


@query("SELECT event_type, rank, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rank FROM events WHERE value IS NOT NULL) WHERE rank IN (1, 50, 77, 150)")
def selected_ranks(spark, d):
    """Values of given ranks by event type, selected without a sort."""
    return stats.at_ranks(table(spark, d, "events"), "value", [1, 50, 77, 150], ("event_type",))


@query("WITH v AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM v), g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM c a JOIN c b USING (id) GROUP BY ALL) SELECT round(sum(g) FILTER (i = j), 4) AS squares, round(sum(g * g), 4) AS fourths FROM g")
def singular_sums(spark, d):
    """Sums of squares and of fourth powers of all singular values of the centred vectors: the Gram matrix's trace and squared norm."""
    _, _, values = stats.svd_components(vectors(spark, d), "v", 64, 64)
    return spark.createDataFrame([(float((values**2).sum()), float((values**4).sum()))], "squares double, fourths double").select(F.round("squares", 4).alias("squares"), F.round("fourths", 4).alias("fourths"))


def _parts(spark, d):
    p = table(spark, d, "part")
    point = lambda t: p.select(F.col("p_partkey").alias(f"{t}_id"), F.col("p_size").cast("double").alias(f"{t}_s"), (F.col("p_retailprice") / 10).alias(f"{t}_r"))
    return point("a"), point("b")


_NEAR = "FROM part a JOIN part b ON pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice / 10 - b.p_retailprice / 10, 2) <= 9"


@query(f"SELECT a.p_partkey AS a_id, b.p_partkey AS b_id {_NEAR}")
def radius_join(spark, d):
    return joins.radius_join(*_parts(spark, d), ["s", "r"], 3.0).select("a_id", "b_id")


@query(f"SELECT a.p_partkey AS a_id, count(*) AS n {_NEAR} GROUP BY 1")
def radius_count(spark, d):
    # SQL has no row for a part without a size or price.
    return joins.radius_count(*_parts(spark, d), ["s", "r"], 3.0).filter("n > 0")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1400")
def box_range(spark, d):
    return joins.in_box(table(spark, d, "part"), {"p_size": 10, "p_retailprice": 950}, {"p_size": 20, "p_retailprice": 1400}).select("p_partkey")


@query(EM + "SELECT a.id AS a_id, b.id AS b_id, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])), 5) AS k FROM e a, e b WHERE b.id % 50 = 0")
def pair_kernel(spark, d):
    df = vectors(spark, d).select("id", "v")
    return joins.vector_kernel(df, df.filter("id % 50 = 0"), "dot", 5)


@query(EM + "SELECT a.id AS a_id, b.id AS b_id, round(-sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.v[i] - b.v[i], 2)))), 5) AS k FROM e a, e b")
def symmetric_kernel(spark, d):
    return joins.vector_kernel(vectors(spark, d).select("id", "v"), None, "distance", 5)


_H = "h AS (SELECT id, least(floor(abs(v) / 0.05), 9)::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2)"


@query(PX + f", {_H}, e AS (SELECT DISTINCT id FROM px), q AS (SELECT a.id AS a_id, b.id AS b_id FROM e a, e b WHERE a.id % 50 = 0), k AS (SELECT a.id AS a_id, b.id AS b_id, sum(least(a.n, b.n)) AS k FROM h a JOIN h b USING (bin) GROUP BY 1, 2) SELECT q.a_id, q.b_id, coalesce(k, 0)::BIGINT AS k FROM q LEFT JOIN k USING (a_id, b_id)")
def intersection_kernel(spark, d):
    h = pixels(spark, d).groupBy("id", stats.bin_of(F.abs("v"), 0.05, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return joins.intersection_kernel(h.filter("id % 50 = 0"), h)


@query(EM + ", g AS (SELECT q.id, q.label, p.id AS g, p.label AS gl, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(range(1, 65), lambda i: q.v[i] * p.v[i])) DESC, p.id) AS r FROM e q, e p WHERE q.id % 50 = 0 AND p.id % 50 <> 0) SELECT id, g AS best, gl AS best_label, label FROM g WHERE r = 1")
def gallery_match(spark, d):
    df = vectors(spark, d)
    gallery = df.filter("id % 50 <> 0").select(F.col("id").alias("g"), F.col("label").alias("g_label"), F.col("v").alias("gv"))
    return joins.gallery_match(df.filter("id % 50 = 0"), gallery).select("id", "best", "best_label", "label")


_LI = "SELECT least(floor(l_quantity / 5), 9)::BIGINT AS a, least(floor(l_discount / 0.02), 4)::BIGINT AS b, least(floor(l_tax / 0.02), 3)::BIGINT AS c FROM lineitem"


def _hist(spark, d):
    scaled = F.array(F.col("l_quantity") / 5, F.col("l_discount") / 0.02, F.col("l_tax") / 0.02)
    return table(spark, d, "lineitem").select(F.array(*[F.least(F.floor(F.get(scaled, F.lit(k))), F.lit(n)).cast("long") for k, n in enumerate((9, 4, 3))]).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a, b, c, count(*) AS n FROM ({_LI}) GROUP BY ALL")
def histogram_nd(spark, d):
    return _hist(spark, d).select(*[F.get("bin", F.lit(k)).alias(x) for k, x in enumerate("abc")], "n")


@query(EM + "SELECT b1, b2, count(*) AS n FROM (SELECT least(floor(abs(v[1]) / 0.1), 3)::BIGINT + 4 * least(floor(abs(v[2]) / 0.1), 3)::BIGINT AS b1, least(floor(abs(v[3]) / 0.1), 3)::BIGINT + 4 * least(floor(abs(v[4]) / 0.1), 3)::BIGINT AS b2 FROM e) GROUP BY ALL")
def histogram_packed(spark, d):
    h = stats.histogram(vectors(spark, d), F.transform(F.slice("v", 1, 4), F.abs), 0.1, 4, pack=2)
    return h.select(F.get("bin", F.lit(0)).alias("b1"), F.get("bin", F.lit(1)).alias("b2"), "n")


@query(f"SELECT a, c, count(*) AS n FROM ({_LI}) GROUP BY ALL")
def marginal_histogram(spark, d):
    h = stats.marginal(_hist(spark, d), [0, 2])
    return h.select(F.get("bin", F.lit(0)).alias("a"), F.get("bin", F.lit(1)).alias("c"), "n")


_ENT = "(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM l GROUP BY {}))"


@query(f"WITH l AS ({_LI}) SELECT round({_ENT.format('a, b, c')}, 6) AS h")
def entropy(spark, d):
    return stats.entropy(_hist(spark, d)).select(r6("h").alias("h"))


@query(f"WITH l AS ({_LI}) SELECT round({_ENT.format('a, b, c')} - {_ENT.format('a')}, 6) AS h")
def conditional_entropy(spark, d):
    return stats.conditional_entropy(_hist(spark, d), [0]).select(r6("h").alias("h"))


@query(f"WITH l AS ({_LI}) SELECT round({_ENT.format('a')} + {_ENT.format('b, c')} - {_ENT.format('a, b, c')}, 6) AS mi")
def mutual_information(spark, d):
    return stats.mutual_information(_hist(spark, d), [0], 3).select(r6("mi").alias("mi"))


@query("SELECT (floor(value / 5) + 100)::BIGINT AS bin, count(*) AS n FROM events WHERE floor(value / 5) + 100 BETWEEN 0 AND 199 GROUP BY 1")
def fixed_histogram(spark, d):
    return stats.fixed_histogram(table(spark, d, "events"), "value", 5.0, 200)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var_pop, round(var_samp(value), 4) AS var_samp, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1")
def mean_variance(spark, d):
    m = stats.moments(table(spark, d, "events"), F.col("value"), ("event_type",))
    return m.select("event_type", r6("mean").alias("mean"), F.round("var_pop", 4).alias("var_pop"), F.round("var_samp", 4).alias("var_samp"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(PX + "SELECT i, round(avg(v), 6) AS m FROM px GROUP BY i")
def vector_mean(spark, d):
    return stats.vector_mean(vectors(spark, d), "v").select(F.posexplode("mean").alias("i", "m")).select("i", r6("m").alias("m"))


@query(PX + ", m AS (SELECT *, v - avg(v) OVER (PARTITION BY i) AS z FROM px) SELECT a.i, b.i AS j, round(avg(a.z * b.z), 7) AS c FROM m a JOIN m b ON a.id = b.id AND b.i >= a.i GROUP BY 1, 2")
def covariance(spark, d):
    return stats.covariance(vectors(spark, d), "v", 64).select("i", "j", F.round("c", 7).alias("c"))


@query(PX + ", m AS (SELECT *, v - avg(v) OVER (PARTITION BY i) AS z FROM px) SELECT id, round(sum(z * CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END), 6) AS p0, round(sum(z * CASE WHEN i < 32 THEN 0.125 ELSE -0.125 END), 6) AS p1 FROM m GROUP BY id")
def pca_project(spark, d):
    """Projection of centred vectors on two fixed components."""
    from ..functions import vectors as V

    df = vectors(spark, d)
    mean = stats.vector_mean(df, "v").scalar()
    z = df.select("id", "v", mean.alias("m")).select("id", F.zip_with("v", "m", lambda x, m: x - m).alias("z"))
    row = lambda f: F.array(*[F.lit(f(i)) for i in range(64)])
    return z.select("id", r6(V.dot(F.col("z"), row(lambda i: 0.125 if i % 2 == 0 else -0.125))).alias("p0"), r6(V.dot(F.col("z"), row(lambda i: 0.125 if i < 32 else -0.125))).alias("p1"))


@query(PX + "SELECT i, round(min(v) / 4, 6) AS mu_lo, round(max(v) / 4, 6) AS mu_hi, round(var_pop(v) / 2, 7) AS var_lo, round(var_pop(v) * 10, 6) AS var_hi FROM px GROUP BY i")
def feature_bounds(spark, d):
    return stats.feature_bounds(vectors(spark, d), "v").select("i", r6("mu_lo").alias("mu_lo"), r6("mu_hi").alias("mu_hi"), F.round("var_lo", 7).alias("var_lo"), r6("var_hi").alias("var_hi"))


@query("SELECT round(avg((quality = toxic)::INT::DOUBLE) * 100, 6) AS accuracy FROM labels")
def accuracy(spark, d):
    return stats.accuracy(table(spark, d, "labels"), "quality", "toxic").select(r6("accuracy").alias("accuracy"))


@query("WITH c AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2), g AS (SELECT a.x::INT AS truth, b.x::INT AS predicted FROM range(0, 2) a(x), range(0, 2) b(x)) SELECT truth, predicted, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY truth), 6) AS share FROM g LEFT JOIN c USING (truth, predicted)")
def confusion_matrix(spark, d):
    return stats.confusion(table(spark, d, "labels"), "quality", "toxic").select("truth", "predicted", r6("share").alias("share"))


@query("WITH n AS (SELECT user_id, event_type AS w, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, sum(n) AS total, max(n) AS top FROM n GROUP BY 1) SELECT a.user_id, w AS winner FROM a LEFT JOIN n ON a.user_id = n.user_id AND n.n * 2 > a.total")
def majority_vote(spark, d):
    return stats.majority(table(spark, d, "events"), ["user_id"], "event_type")


@query(PX + "SELECT id, floor(sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2)))::INT AS r, round(sum(v), 5) AS s FROM px GROUP BY 1, 2")
def radial_profile(spark, d):
    return stats.radial_profile(pixels(spark, d), 3.5, 3.5).select("id", "r", F.round("s", 5).alias("s"))


@query("SELECT (vec_id % 4)::INT AS k, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, d):
    return vectors(spark, d).select((F.col("id") % 4).cast("int").alias("k"), F.lit(0.0).alias("d2"), "v").transform(lambda t: encoders.cluster_stats(t, "v")[0]).select("k", "size")
