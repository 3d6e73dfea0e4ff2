"""Files of many records: how much of them reaches a Python worker at once."""

import numpy as np

from arrayloom.sources import readers


def test_files_are_written_few_at_a_time(spark, tmp_path):
    """A task's files don't come to Python as one batch: no plan of Arrow batches between contents and files."""
    files = spark.range(300, numPartitions=1).selectExpr("concat('part-', lpad(id, 3, '0')) AS file", "encode(cast(id AS string), 'utf-8') AS content")
    seen = []
    held, readers.staged = readers.staged, lambda df, name: seen.append(df) or held(df, name)
    try:
        done = readers.save_files(files, str(tmp_path / "out"), ".x")
    finally:
        readers.staged = held
    assert "MapInPandas" not in seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert {r.path: r.bytes for r in done.collect()} == {f"{tmp_path}/out/part-{i:03d}.x": len(str(i)) for i in range(300)}
    assert all((tmp_path / "out" / f"part-{i:03d}.x").read_text() == str(i) for i in range(300))


def test_stl_images_are_decoded_where_they_are_read(spark, tmp_path):
    """Labels of several files go to spans of several files; images without a label go; no image is joined or sorted."""
    for name, values in (("x1", [1, 2, 3]), ("x2", [4, 5])):
        (tmp_path / name).write_bytes(b"".join(bytes([v] * 27648) for v in values) + b"end")
    (tmp_path / "y1").write_bytes(bytes([200, 11]))
    (tmp_path / "y2").write_bytes(bytes([12, 13]))
    got = readers.read_stl(spark, str(tmp_path / "x*"), str(tmp_path / "y*"), 2 * 27648)
    assert got.columns == ["path", "pos", "label", "channels", "rows", "cols", "data"]
    rows = sorted((r.path[-2:], r.pos, r.label, r.data[0], sum(r.data)) for r in got.collect())
    assert rows == [("x1", 0, 200, 1.0, 27648.0), ("x1", 1, 11, 2.0, 2 * 27648.0), ("x1", 2, 12, 3.0, 3 * 27648.0), ("x2", 0, 13, 4.0, 4 * 27648.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = next(k for k, line in enumerate(plan) if "MapInPandas" in line)
    assert not any("Join" in line for line in plan[:first])
    pixels = np.arange(27648) % 251
    (tmp_path / "z").write_bytes(pixels.astype(np.uint8).tobytes())
    (tmp_path / "w").write_bytes(bytes([7]))
    one = readers.read_stl(spark, str(tmp_path / "z"), str(tmp_path / "w")).first()
    assert np.array_equal(one.data, pixels.reshape(3, 96, 96).transpose(0, 2, 1).ravel())
