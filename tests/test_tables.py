import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import ordered
from lattica.sources import tables


def test_labels_round_trip(spark, tmp_path):
    rows = [("a/b.png", "x y"), ("c.png", "tab\tinside"), ("d.png", "é")]
    tables.write_labels(spark.createDataFrame(rows, "path string, label string"), str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_labels(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    (tmp_path / "bad.tsv").write_text("only a path\n")
    with pytest.raises(Exception, match="malformed"):
        tables.read_labels(spark, str(tmp_path / "bad.tsv")).collect()
    with pytest.raises(Exception, match="no line can hold"):
        tables.write_labels(spark.createDataFrame([("a\tb", "x")], "path string, label string"), str(tmp_path / "no"))


def test_detections_and_licences(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"split": "train", "image_id": "i", "crop_xyxy": [0, 0, 5, 5], "objects": [{"category_id": "a", "label": 1, "box_xyxy": [0, 1, 2, 3.5]}]}\n')
    row = tables.read_detections(spark, str(tmp_path / "d.jsonl")).first()
    assert (row.split, row.crop_xyxy, row.objects[0].box_xyxy) == ("train", [0, 0, 5, 5], [0.0, 1.0, 2.0, 3.5])
    (tmp_path / "l.csv").write_text(",".join(tables.LICENCE_COLUMNS) + "\n" + ",".join(["x"] * len(tables.LICENCE_COLUMNS)) + "\n")
    assert tables.read_licences(spark, str(tmp_path / "l.csv")).count() == 1
    (tmp_path / "m.csv").write_text("metadata,mxl\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        tables.read_licences(spark, str(tmp_path / "m.csv"))


def test_manifest(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_text(name * 3)
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path))
    manifest = spark.createDataFrame(tables.integrity_manifest(read(), F.lit("score")).collect())
    assert {r.sha256 for r in manifest.collect()} == {hashlib.sha256((n * 3).encode()).hexdigest() for n in "abcd"}
    assert tables.verify_manifest(manifest, read()).isEmpty()
    (tmp_path / "a").write_text("aab")
    (tmp_path / "b").write_text("b")
    (tmp_path / "c").unlink()
    (tmp_path / "e").write_text("e")
    twice = manifest.unionByName(manifest.where("path like '%/d'"))
    assert {(r.path[-1], r.problem) for r in tables.verify_manifest(twice, read()).collect()} == {("a", "rehashed"), ("b", "resized"), ("c", "missing"), ("d", "duplicate"), ("e", "unlisted")}


@pytest.mark.parametrize("seed", range(20))
def test_alignment_costs_least(seed):
    rng = random.Random(seed)
    a, b = (rng.choices("abc", k=rng.randrange(6)) for _ in range(2))
    gap = rng.choice([0.62, 0.92, 1.0])
    cost = ordered.position_penalty(len(a), len(b))
    for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)):
        cost[i, j] = min(1.0, cost[i, j] + (x != y))
    best = min(sum(cost[i, j] for i, j in zip(rows, columns)) + gap * (len(a) + len(b) - 2 * k) for k in range(min(len(a), len(b)) + 1) for rows in itertools.combinations(range(len(a)), k) for columns in itertools.combinations(range(len(b)), k))
    pairs, total = ordered.align_costs(cost, gap)
    assert abs(total - best) < 1e-9
    assert abs(sum(gap if i is None or j is None else cost[i, j] for i, j in pairs) - best) < 1e-9
    assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
