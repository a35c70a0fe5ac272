import itertools
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.functions.notation import direction_end, greedy_ctc, tree_is_valid, tree_value
from lattica.operators import clusters, matching, metrics
from lattica.plans.registry import ORACLE_SQL, QUERIES
from lattica.sources.scores import notes_of, read_scores
from lattica.streaming import rates

SCORE = """<score-partwise><part-list><score-part id="P1"/></part-list><part id="P1"><measure number="1">
<attributes><divisions>2</divisions></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>3</duration><voice>1</voice><dot/></note>
<note><chord/><pitch><step>E</step><alter>-1</alter><octave>4</octave></pitch><duration>3</duration></note>
<note><grace/><pitch><step>D</step><octave>5</octave></pitch></note>
<note><rest/><duration>1</duration></note><backup><duration>4</duration></backup>
<note><pitch><step>A</step><octave>2</octave></pitch><duration>8</duration><voice>2</voice></note>
</measure></part></score-partwise>"""


def test_registered():
    assert {"SRC6_tokens", "CLU1_suppression", "SCORE3_tree"} <= set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)


def test_notes():
    got = [(n["onset_n"] / n["onset_d"], n["dur_n"] / n["dur_d"], n["step"], n["chord"], n["grace"]) for n in notes_of(SCORE.encode())]
    assert got == [(0, 1.5, "C", False, False), (0, 1.5, "E", True, False), (1.5, 0, "D", False, True), (1.5, 0.5, None, False, False), (0, 4, "A", False, False)]


def test_reader_keeps_bad_files(spark, tmp_path):
    (tmp_path / "a.musicxml").write_text(SCORE)
    (tmp_path / "b.musicxml").write_text("<score-partwise>")
    got = read_scores(spark, str(tmp_path)).groupBy(F.col("error").isNull().alias("ok")).count().collect()
    assert {r["ok"]: r["count"] for r in got} == {True: 5, False: 1}


def test_trees(spark):
    leaf = {"feature": -2, "threshold": 0, "left": -1, "right": -1, "value": 2.0}
    loop = [{"feature": 0, "threshold": 0, "left": 0, "right": 1, "value": 0}, leaf]
    assert tree_is_valid([leaf], 0) and not tree_is_valid(loop, 1) and not tree_is_valid([leaf, leaf], 0)
    node = [{"feature": 0, "threshold": 1.0, "left": 1, "right": 2, "value": 0}, leaf, leaf | {"value": 3.0}]
    rows = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),), (None,)], "x double").select(tree_value(node, [F.col("x")]).alias("v"), tree_value(loop, [F.col("x")]).alias("w")).collect()
    assert [r["v"] for r in rows] == [2.0, 3.0, 0.0, 0.0] and {r["w"] for r in rows} == {0.0}


def test_suppression(spark):
    rows = [("a", 1, 0.0, 0.0, 10.0, 10.0, 5.0), ("a", 1, 0.0, 0.0, 10.0, 10.0, 5.0), ("a", 2, 1.0, 0.0, 11.0, 10.0, 9.0), ("a", 3, 30.0, 0.0, 40.0, 10.0, 1.0), ("b", 1, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "page string, item int, x1 double, y1 double, x2 double, y2 double, score double")
    got = sorted(tuple(r) for r in clusters.suppress(df, ["page"], "item", ["x1", "y1", "x2", "y2"], "score", 0.5).collect())
    assert got == [("a", 2), ("a", 3), ("b", 1)]
    twins = clusters.suppress(df.where("item = 1 and page = 'a'"), ["page"], "item", ["x1", "y1", "x2", "y2"], "score", 0.5)
    assert twins.count() == 1


def test_average_precision_of_many_positives(spark):
    rows = [(i, 1000.0 - i, int(i % 3 != 1)) for i in range(600)]
    got = metrics.average_precision(spark.createDataFrame(rows, "id int, s double, y int").withColumn("g", F.lit(1)), ["g"], "s", "y", "id").first()
    tp = np.cumsum([y for _, _, y in rows])
    p, r = tp / np.arange(1, 601), tp / tp[-1]
    assert abs(got.ap - np.mean([p[r >= k / 100].max() for k in range(101)])) < 1e-12 and got.ap <= 1


def test_ctc(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([9.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 9.0, 9.0, 0.0, 0.0, 0.0, 9.0, 0.0],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(greedy_ctc(F.col("x"), 3)).collect()][:2] == [[], [0, 0, 1]]


def test_text_rules(spark):
    df = spark.createDataFrame([("  12 / 8 ", "Allegro"), ("Moderato, ", "a b 3"), ("A very long piece of words", "Crème vvord |2"), ("a<b>:c . ", " . "), ("no. 1849, 1850-1951x1790", "The Études for Piano")], "a string, b string")
    got = df.select(S.text_family(F.col("a")), S.safe_filename(F.col("a")), S.confusion_skeleton(F.col("b")), S.year_candidates(F.col("a")), S.title_similarity(F.col("b"), F.lit("études the solo"))).collect()
    assert [r[0] for r in got] == ["numeric", "music_word", "metadata_mixed", "music_word", "metadata_mixed"]
    assert [r[1] for r in got][3] == "a_b__c" and [r[2] for r in got][2] == "cremewordlz"
    assert got[4][3] == [1849, 1850] and got[4][4] == 1 / 4 and got[3][4] == 0.0


@pytest.mark.parametrize("seed", range(30))
def test_matchings(seed):
    rng = np.random.default_rng(seed)
    iou = np.round(rng.random((rng.integers(0, 6), rng.integers(0, 6))) * rng.integers(0, 2, 1), 1)
    best = max((sum(iou[i, j] >= 0.5 for i, j in zip(rows, columns)) for k in range(min(iou.shape) + 1) for rows in itertools.combinations(range(iou.shape[0]), k) for columns in itertools.permutations(range(iou.shape[1]), k)), default=0)
    found = matching.maximum_matches(iou, 0.5)
    assert len(found) == best and len({i for i, _ in found}) == len({j for _, j in found}) == best and all(iou[p] >= 0.5 for p in found)
    taken = set()
    for i, j in matching.greedy_matches(iou, 0.5):
        assert iou[i, j] >= 0.5 and all(iou[i, c] <= iou[i, j] for c in range(iou.shape[1]) if c not in taken)
        taken.add(j)


def _some_boxes(rng, n: int, pages: int, wide: int):
    x = rng.integers(0, 30, (n, 2))
    page = [None if p == 0 else int(p) for p in rng.integers(0, pages, n)]
    score = [None if v == 0 else float("nan") if v == 1 else float(v) for v in rng.integers(0, 9, n)]
    return [(p, i, float(a), float(b), float(a + rng.integers(0, wide)), float(b + rng.integers(0, wide)), v) for i, (p, (a, b), v) in enumerate(zip(page, x.tolist(), score, strict=True))]


BOXES = "page int, item long, x1 double, y1 double, x2 double, y2 double, score double"


def _in_order(rows):
    """By falling score, null and NaN last, and then by item."""
    return sorted(rows, key=lambda r: (r[6] is None or r[6] != r[6], -(r[6] or 0) if r[6] == r[6] else 0, r[1]))


def _pages(rows):
    return {p: [r for r in rows if r[0] == p] for p in {r[0] for r in rows}}


def test_whole_groups(monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 5)
    keys = [None] * 3 + [float("nan")] * 2 + [1.0] * 13 + [2.0, 3.0, 3.0]
    rows = pa.record_batch({"k": pa.array(keys), "i": pa.array(range(len(keys)))})
    for size in (1, 2, 4, 21):
        got = [(b.column(0).to_pylist(), b.column(1).to_pylist(), g.tolist()) for b, g in clusters.whole_groups((rows.slice(a, size) for a in range(0, len(keys), size)), 1)]
        groups = [[i[k] for k in range(len(i)) if g[k] == n] for _, i, g in got for n in dict.fromkeys(g)]
        assert groups == [[0, 1, 2], [3, 4], list(range(5, 18)), [18], [19, 20]]
    assert list(clusters.whole_groups(iter([rows.slice(0, 0)]), 1)) == []


@pytest.mark.parametrize("pages", [2, 400])
def test_suppression_box_by_box(spark, pages):
    rows = _some_boxes(np.random.default_rng(pages), 900, pages, 15)
    want = set()
    for page, boxes in _pages(rows).items():
        kept = []
        for r in _in_order(boxes):
            if not kept or (clusters.box_iou(np.array(r[2:6]), np.array([k[2:6] for k in kept])) < 0.3).all():
                kept.append(r)
        want |= {(page, r[1]) for r in kept}
    got = clusters.suppress(spark.createDataFrame(rows, BOXES), ["page"], "item", ["x1", "y1", "x2", "y2"], "score", 0.3).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("method", [matching.greedy_matches, matching.maximum_matches])
@pytest.mark.parametrize("pages", [2, 300])
def test_matches_page_by_page(spark, pages, method):
    rows = _some_boxes(np.random.default_rng(pages), 900, pages, 15)
    found, truth = rows[::2], rows[1::2]
    want = set()
    for page, f in _pages(found).items():
        f, t = _in_order(f), [r for r in truth if r[0] == page]
        iou = np.array([clusters.box_iou(np.array(r[2:6]), np.array([k[2:6] for k in t]).reshape(-1, 4)) for r in f]).reshape(len(f), len(t))
        want |= {(page, f[i][1], t[j][1]) for i, j in method(iou, 0.2)}
    got = matching.match_boxes(spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, BOXES), "page", "item", "score", 0.2, method).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("method", [matching.greedy_matches, matching.maximum_matches])
def test_large_page_without_its_matrix(method):
    """3,000 by 3,000 boxes: their IoU, 72 MB, is never held at once."""
    x = np.random.default_rng(0).integers(0, 2000, (6000, 2)).astype(float)
    x = np.hstack([x, x + 20])
    tracemalloc.start()
    got = matching._batch_matches(x, np.array([0]), np.array([3000]), np.array([3000]), 0.1, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = sorted((int(i), int(j) - 3000) for a, b in got for i, j in zip(a, b, strict=True))
    assert peak < 16 << 20, peak
    assert pairs == sorted(method(np.array([clusters.box_iou(b, x[3000:]) for b in x[:3000]]), 0.1))


@pytest.mark.parametrize("run", [
    lambda b: clusters.suppress(b, ["page"], "item", ["x1", "y1", "x2", "y2"], "score", 0.3),
    lambda b: matching.match_boxes(b.where("item % 2 = 0"), b.where("item % 2 = 1"), "page", "item", None, 0.1, matching.maximum_matches),
    lambda b: matching.match_boxes(b.where("item % 2 = 0"), b.where("item % 2 = 1"), "page", "item", "score", 0.1),
])
def test_many_small_pages(spark, run):
    """100,000 pages of four boxes in 30 s; a data frame a page took minutes."""
    boxes = spark.range(400_000).selectExpr("id div 4 as page", "id as item", "double(id % 7 * 10) as x1", "0D as y1", "double(id % 7 * 10 + 15) as x2", "9D as y2", "double(id % 5) as score")
    began = time.monotonic()
    assert run(boxes).count() > 0 and time.monotonic() - began < 30


def test_running_median(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0, 7.0, 20.0],), ([],)], "x array<double>")
    got = [r[0] for r in rows.select(clusters.running_median_clusters(F.col("x"), 3.0)).collect()]
    assert got == [[[1.0, 2.0, 4.0], [7.0], [20.0]], []]


@pytest.mark.parametrize("again", [False, True])
def test_stream(spark, tmp_path, sf, again):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.unionByName(events).coalesce(1).write.parquet(source)
    for _ in itertools.repeat(None, 1 + again):
        stream = rates.once_each(rates.read_files(spark, source, events.schema), ["event_id"], "ts", "3650 days")
        rates.run_available(stream, out, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(out).count() == events.count()


def test_direction_end(spark):
    rows = spark.createDataFrame([("wedge", "1"), ("wedge", None), ("words", "1"), (None, "2"), ("words", None)], "kind string, e string")
    assert [r[0] for r in rows.select(direction_end(F.col("kind"), F.col("e"))).collect()] == ["", "", "1", "2", None]
