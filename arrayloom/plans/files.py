"""Queries: tables written in the file formats and read back; models saved and loaded; class folders."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..operators import classifiers, mixtures
from ..sources import models, readers
from .models import _first, _linear, _mixture
from .registry import EM, PX, images, query, r6, table, vectors

#: Pixels from least to greatest as bytes.
_BYTES = EM + ", b AS (SELECT id, label, list_transform(v, lambda x: round_even((x - list_min(v)) / (list_max(v) - list_min(v)) * 255, 0)) AS q FROM e) "


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _bytes(r) -> np.ndarray:
    a = np.asarray(r.data, dtype=float)
    return np.round((a - a.min()) / (a.max() - a.min()) * 255).astype(np.uint8).reshape(r.rows, r.cols)


def _written(spark, df, encode, per_file=10, suffix=""):
    """The folder's files, written by tasks."""
    folder = _folder(spark)
    readers.save_files(readers.encoded_files(df, encode, per_file) if encode else df, folder, suffix)
    return f"{folder}/part-*"


def _id(per_file=10):
    """The number of a row from its file's number and its place."""
    return F.regexp_extract("path", "part-(\\d+)", 1).cast("long") * per_file + F.col("pos")


def _sum(c: str):
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


@query(_BYTES + "SELECT id, label, 1 AS channels, 8 AS rows, 8 AS cols, list_sum(q) AS s, q[11] AS q10 FROM b")
def labelled_array_files(spark, d):
    path = _written(spark, readers.labelled_files(images(spark, d), 10), None)
    df = readers.read_labelled_arrays(spark, path, span=300)
    return df.select(_id().alias("id"), "label", "channels", "rows", "cols", _sum("data").alias("s"), F.get("data", F.lit(10)).alias("q10"))


@query(_BYTES + "SELECT id, label, list_sum(q) AS s FROM b WHERE id % 10 < 3")
def labelled_array_prefix(spark, d):
    """The first three records of each file."""
    df = readers.read_labelled_arrays(spark, _written(spark, readers.labelled_files(images(spark, d), 10), None), first=3)
    return df.select(_id().alias("id"), "label", _sum("data").alias("s"))


@query("SELECT vec_id // 10 AS file, count(*) AS records FROM embeddings GROUP BY 1")
def labelled_array_counts(spark, d):
    df = readers.record_counts(spark, _written(spark, readers.labelled_files(images(spark, d), 10), None))
    return df.select(F.regexp_extract("path", "part-(\\d+)", 1).cast("long").alias("file"), "records")


@query(_BYTES + "SELECT id, label, 432 * list_sum(q) AS s, q[(32 * 5 + 7) % 64 + 1] AS at FROM b")
def stl_files(spark, d):
    """Images tiled to records of 3 x 96 x 96, stored by column, and their labels in a file of bytes."""
    df = images(spark, d)
    x = _written(spark, df, lambda b: b"".join(np.tile(_bytes(r).ravel(), 432).tobytes() for r in b.itertuples()))
    y = _written(spark, df, lambda b: bytes(int(r.label) for r in b.itertuples()))
    # Spans of four images, so that files are split.
    out = readers.read_stl(spark, x, y, 4 * 27648)
    return out.select(_id().alias("id"), "label", _sum("data").alias("s"), F.get("data", F.lit(96 * 7 + 5)).alias("at"))


@query(PX + "SELECT label, round(sum(v), 4) AS s, round(max(CASE WHEN y = 1 AND x = 3 THEN v END), 5) AS at FROM px GROUP BY id, label")
def digit_lines(spark, d):
    """Lines of pixels by column and a label."""
    by_column = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("v", (i % 8) * 8 + F.floor(i / 8).cast("int")))
    path = _folder(spark)
    vectors(spark, d).select(F.concat_ws(" ", F.concat(by_column.cast("array<string>"), F.array(F.col("label").cast("string"))))).write.text(path)
    return readers.read_digits(spark, path, 8).select("label", F.round(_sum("data"), 4).alias("s"), F.round(F.get("data", F.lit(11)), 5).alias("at"))


@query(_BYTES + "SELECT id, label AS tag, 8 AS width, 8 AS height, list_sum(q)::DOUBLE AS s FROM b")
def character_files(spark, d):
    encode = lambda b: readers.encode_characters([(int(r.label), _bytes(r).astype(int)) for r in b.itertuples()])
    df = readers.read_characters(spark, _written(spark, images(spark, d), encode))
    value = lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("double")
    return df.select(_id().alias("id"), "tag", "width", "height", F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(64)), value), F.lit(0.0), lambda s, x: s + x).alias("s"))


@query(_BYTES + "SELECT id, label AS tag, len(list_filter(q, lambda x: x <> 0))::INT AS n, list_sum(q)::DOUBLE AS s, q[21] AS at FROM b")
def sparse_character_files(spark, d):
    """Read sparse, and one pixel of the dense form."""
    encode = lambda b: readers.encode_sparse_characters([(int(r.label), _bytes(r)) for r in b.itertuples()])
    df = readers.read_sparse_characters(spark, _written(spark, images(spark, d), encode))
    return df.select(_id().alias("id"), "tag", F.size("i").alias("n"), _sum("v").alias("s"), F.get(readers.sparse_to_dense(F.col("i"), F.col("v"), 64), F.lit(20)).alias("at"))


@query(EM + "SELECT id, label::DOUBLE AS label, len(list_filter(v, lambda x: x > 0))::INT AS n, round(list_sum(list_filter(v, lambda x: x > 0)), 5) AS s FROM e")
def sparse_row_files(spark, d):
    """Positive values as sparse feature rows."""
    df = vectors(spark, d)
    encode = lambda b: readers.encode_sparse([(float(r.label), {i: x for i, x in enumerate(r.v) if x > 0}) for r in b.itertuples()])
    return readers.read_sparse(spark, _written(spark, df, encode)).select(_id().alias("id"), "label", F.size("i").alias("n"), F.round(_sum("v"), 5).alias("s"))


@query(_BYTES + "SELECT id, 1 AS channels, 8 AS rows, 8 AS cols, list_sum(q) AS s, q[30] AS at FROM b")
def picture_files(spark, d):
    df = readers.read_images(spark, _written(spark, images(spark, d), lambda b: readers.encode_netpbm(_bytes(b.iloc[0])[None].astype(float)), 1))
    return df.select(F.regexp_extract("path", "part-(\\d+)", 1).cast("long").alias("id"), "channels", "rows", "cols", _sum("data").alias("s"), F.get("data", F.lit(29)).alias("at"))


@query("SELECT label::DOUBLE AS label, count(*) AS n FROM embeddings GROUP BY 1")
def label_lines(spark, d):
    path = _folder(spark)
    vectors(spark, d).select(F.col("label").cast("string")).write.text(path)
    return readers.read_labels(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name || '/' || p_partkey AS path FROM part")
def path_lines(spark, d):
    path = _folder(spark)
    table(spark, d, "part").select(F.concat_ws("/", "p_name", F.col("p_partkey").cast("string"))).write.text(path)
    return readers.read_paths(spark, path)


@query("SELECT 'img/' || p_partkey AS path, p_size AS label, (p_partkey % 7)::INT AS x, (p_partkey % 5)::INT AS y, p_size AS w, p_size + 1 AS h FROM part")
def landmark_lines(spark, d):
    path, k = _folder(spark), F.col("p_partkey")
    line = F.format_string('("img/%d",%d,((%d,%d),(%d,%d)))', k, "p_size", k % 7, k % 5, "p_size", F.col("p_size") + 1)
    table(spark, d, "part").select(line).write.text(path)
    return readers.read_landmarks(spark, path)


@query("SELECT p_partkey, p_brand AS label, p_partkey <= 100 AS half FROM part")
def class_folder_paths(spark, d):
    """Paths of files in folders that stand for classes, and the first half of the numbers."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.lit("root"), "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))).alias("path"))
    return readers.half_split(readers.labelled_by_folder(p), "id", 100).select(F.col("id").alias("p_partkey"), "label", F.col("train").alias("half"))


@query("SELECT p_brand, least(count(*), 4) AS train, count(*) - least(count(*), 4) AS test FROM part GROUP BY 1")
def drawn_per_class(spark, d):
    """Four of each class are drawn to train; which, depends on the seed."""
    p = readers.first_per_class(table(spark, d, "part"), 4, 3, "p_brand", "p_partkey")
    return p.groupBy("p_brand").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


def _reloaded(spark, model):
    path = f"{_folder(spark)}/model"
    models.trained_once(spark, path, lambda: model)
    return models.trained_once(spark, path, lambda: 1 / 0)  # the second time it is there


def _cells(spark, **arrays):
    rows = [(name, i, j, float(x)) for name, a in arrays.items() for i, r in enumerate(np.atleast_2d(a)) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "part string, i int, j int, x double").withColumn("x", r6("x"))


_CENTERS = EM + ", c AS (SELECT id::INT AS i, (generate_subscripts(v, 1) - 1)::INT AS j, unnest(v) AS x FROM e WHERE id < {}) "


@query(_CENTERS.format(4) + "SELECT 'centers' AS part, i, j, round(x, 6) + 0.0 AS x FROM c UNION ALL SELECT 'sizes', 0, r::INT, r * 10.0 FROM range(0, 4) t(r)")
def saved_kmeans(spark, d):
    centers, sizes = _reloaded(spark, (_first(spark, d, 4), np.arange(4) * 10.0))
    return _cells(spark, centers=centers, sizes=sizes)


@query(_CENTERS.format(3) + "SELECT 'mu' AS part, i, j, round(x, 6) + 0.0 AS x FROM c UNION ALL SELECT 'var', i, j, 0.05 FROM c UNION ALL SELECT 'w', 0, r::INT, round((r + 1) / 6, 6) FROM range(0, 3) t(r)")
def saved_mixture(spark, d):
    w, mu, var = _reloaded(spark, _mixture(spark, d))
    return _cells(spark, w=w, mu=mu, var=var)


@query(_CENTERS.format(3) + "SELECT 'mean' AS part, 0 AS i, j, round(x, 6) + 0.0 AS x FROM c WHERE i = 0 UNION ALL SELECT 'rows', i - 1, j, round(x, 6) + 0.0 FROM c WHERE i > 0 UNION ALL SELECT 'values', 0, r::INT, 2.0 - r FROM range(0, 2) t(r)")
def saved_pca(spark, d):
    v = _first(spark, d, 3)
    mean, rows, values = _reloaded(spark, (v[0], v[1:], np.array([2.0, 1.0])))
    return _cells(spark, mean=mean, rows=rows, values=values)


@query(_CENTERS.format(3) + "SELECT 'mu' AS part, 0 AS i, j, round(x, 6) + 0.0 AS x FROM c WHERE i = 0 UNION ALL SELECT 'w', j, i - 1, round(x, 6) + 0.0 FROM c WHERE i > 0 UNION ALL SELECT 'rest', 0, 0, 0.25 UNION ALL SELECT 'rest', 0, 1, 0.5")
def saved_ppca(spark, d):
    v = _first(spark, d, 3)
    (m,) = _reloaded(spark, [mixtures.Ppca(0.25, v[0], v[1:].T, 0.5)])
    return _cells(spark, mu=m.mu, w=m.w, rest=np.array([m.weight, m.noise]))


@query(EM + "SELECT 'weights' AS part, k AS i, (generate_subscripts(v, 1) - 1)::INT AS j, round(unnest(v), 6) + 0.0 AS x FROM (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, v FROM (SELECT id, v FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1))")
def saved_linear(spark, d):
    return _cells(spark, weights=_reloaded(spark, _linear(spark, d)).weights)


@query(_CENTERS.format(3) + "SELECT 'vectors' AS part, i, j, round(x, 6) + 0.0 AS x FROM c UNION ALL SELECT 'alphas', 0, r::INT, r - 1.0 FROM range(0, 3) t(r) UNION ALL SELECT 'rest', 0, 0, 0.5 UNION ALL SELECT 'rest', 0, 1, 0.125")
def saved_kernel(spark, d):
    machines = _reloaded(spark, {7.0: classifiers.Kernel(_first(spark, d, 3), np.array([-1.0, 0.0, 1.0]), 0.5, "rbf", 0.125)})
    k = machines[7.0]
    return _cells(spark, vectors=k.vectors, alphas=k.alphas, rest=np.array([k.bias, k.gamma]))


@query(PX + "SELECT i AS filter, round(avg(abs(v)), 6) AS mean, round(var_pop(abs(v)), 6) AS variance FROM px GROUP BY 1")
def saved_filter_stats(spark, d):
    """Statistics of magnitudes by filter (here: by element), saved and loaded."""
    m = vectors(spark, d).select(F.posexplode("v").alias("filter", "v")).withColumn("m", F.abs("v"))
    s = _reloaded(spark, models.magnitude_stats(m, "filter", "m"))
    rows = [(int(f), float(a), float(b)) for f, a, b in zip(s["filter"], s["mean"], s["variance"], strict=True)]
    return spark.createDataFrame(rows, "filter int, mean double, variance double").select("filter", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("SELECT vec_id AS id, least((row_number() OVER (ORDER BY vec_id) - 1) // ((SELECT count(*) FROM embeddings) // 7), 7)::INT AS fold FROM embeddings")
def fold_numbers(spark, d):
    """Seven contiguous folds; the rest has number 7."""
    return classifiers.folds(vectors(spark, d), 7).select("id", "fold")
