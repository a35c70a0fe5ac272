"""Each operator against SQL or a brute-force version, and on nulls, empty and odd rows."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lattica.llm import decontaminate, jaccard_join, mixing, neighbours, pii, quality, sharding, substring_dedup, token_files, url_filter
from lattica.llm.common import Scratch
from lattica.llm.components import components
from lattica.llm.queries import ORACLE_SQL, QUERIES
from lattica.llm.words import word_hashes
from tests.oracle import compare

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


def small_docs(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 12, 13, 30, 60]))) for _ in range(n)]
    for i in range(0, n, 4):  # copies, near copies, shared passages
        base = texts[i].split()
        texts[i + 1] = " ".join(base)
        if len(base) > 20:
            texts[i + 2] = " ".join([*base[:-2], "x", "y"])
            texts[i + 3] += " " + " ".join(base[:15])
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n ", "en", None, 4), (3, texts[3], "en", "s0", len(texts[3]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(small_docs(), DOCS)


def test_word_hashes():
    texts = [None, b"", b" \n", b"a b  a\x0bc", "é\u00a0b c".encode(), b"y" * 70_000 + b" z"]
    got = [h.tolist() for h in word_hashes(texts)]
    assert [len(h) for h in got] == [len((t or b"").split()) for t in texts]
    assert got[3][0] == got[3][2] and len({*got[3], *got[4], *got[5]}) == 6  # a b c, "é\u00a0b", y..., z


def parity_words(n):
    """Two words that every polynomial hash modulo 2^64 takes for one, from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096, 70_000])
def test_words_that_powers_confuse(spark, n):
    x, y = parity_words(n)
    assert len({h for seed in (0, 1) for w in word_hashes([x.encode(), y.encode()], seed) for h in w.tolist()}) == 4
    rest = " ".join(f"r{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{x} {rest}", None, None, 0), (2, f"{y} {rest}", None, None, 0)], DOCS)
    assert {r.n_removed for r in substring_dedup.dedup(df).collect()} == {0}
    pair = spark.createDataFrame([(1, x, None, None, 0), (2, y, None, None, 0)], DOCS)
    assert {r.component_id for r in jaccard_join.link_components(pair).collect()} == {1, 2}


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words[:30]), " ".join(words[30:]), " ".join(words[10:25])
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in [(1, a), (5, a), (5, b), (5, "x"), (7, c), (7, b), (7, b), (None, b), (None, c)]], DOCS)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert got == [(0, 15, 0), (0, 30, 0), (1, 30, 15), (5, 1, 0), (5, 30, 30), (5, 30, 30), (7, 15, 15), (7, 30, 30), (7, 30, 30)]
    near = jaccard_join.link_components(df).collect()
    assert {(r.doc_id, r.component_id) for r in near} == {(1, 1), (5, 1), (7, 1), (None, None)}


def brute_removed(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_substring_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.dedup(docs, batches=3).collect()
    want = brute_removed(rows)
    assert len(got) == len(rows)
    assert all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert any(r.n_removed for r in got)
    assert substring_dedup.dedup(docs.where("doc_id < 0")).count() == 0


def test_url_filter(spark):
    urls = [None, "", "net/x", "http://NET/", "http://a.net", "http://a.net/", "https://x.example.net/en/1", "http://example.net/en", "http://org/fr/?q", "http://a.org/fr/#x", "http://notexample.com/de/", "http://h.example.com/de/?u://z", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert [got[i][2] for i in range(len(urls))] == [None, None, None, "net/", None, "net/", "example.net/en/", "net/", "org/fr/", "org/fr/", None, "example.com/de/", None]
    assert got[3][:2] == ("net", "/") and got[4][:2] == ("a.net", "") and got[0][:2] == ("", "")
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.select_scores(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect()]
    good = [r.doc_id in kept for r in held if r.quality == 1 and not r.toxic]
    junk = [r.doc_id in kept for r in held if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(junk) < 0.1


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_scores(docs, none).count() == docs.count()
    some = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (4, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, some).select(*docs.columns).count() <= docs.count()
    assert quality.select_scores(docs.limit(0), some).count() == 0


def test_quality_counts_unlabelled_text(spark):
    rng = random.Random(4)

    def text(letter):
        return " ".join(f"{letter}{rng.randrange(40)}" for _ in range(80))

    kinds = [("g", 1, 0), ("b", 0, 0)]  # u: junk that no label shows
    rows = [(i, text("g" if i < 400 else "b" if i < 500 else "u"), "en", "s", 0) for i in range(900)]
    labels = [(i, *kinds[i >= 400][1:]) for i in range(500) if i % 4 == 0]
    frame = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select_scores(*frame).collect()}
    assert sum(i < 400 for i in kept) > 380 and sum(i >= 400 for i in kept) < 10
    model = quality.fit(*frame)
    assert model.raw_size[model.languages["en"]] == sum(2 * 80 - 1 for _ in rows)


@pytest.mark.parametrize(("lang", "marks"), [("xx", [(1, 0)] * 3), (None, [(1, 0)] * 3), ("xx", [(0, 0)] * 2), ("xx", [])])
def test_quality_language_lacks_a_kind(spark, lang, marks):
    rng = random.Random(5)

    def text(prefix, rude):
        return " ".join([*(f"{prefix}{rng.randrange(50)}" for _ in range(30)), *(f"rude{rng.randrange(5)}" for _ in range(rude))])

    rows = [(i, text("e", 8 * (i % 5 == 0)), "en", "s", 0) for i in range(400)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)] + [(1000 + i, *m) for i, m in enumerate(marks)] + [(399, 0, 0)]
    rows += [(1000 + i, text("x", 0), lang, "s", 0) for i in range(40)] + [(2000 + i, text("x", 8), lang, "s", 0) for i in range(40)]
    model = quality.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weights = {i: np.exp(model.log_posterior(lang, quality.features(word_hashes([t.encode()])[0], 1 << 17))) for i, t, *_ in rows if i >= 1000}
    toxic, clean = (np.mean([w for i, w in weights.items() if (i >= 2000) == bad]) for bad in (True, False))
    assert toxic < 0.1 and (clean > 0.5 or (0, 0) in marks), (toxic, clean)


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    values = [float((i * 7919) % 331) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    t = quality.kth_largest(df, "v", k, bins=4)
    kept = [v for v in values if v >= t]
    assert len(kept) >= min(k, 1000) and (k == 0) == (not kept)
    assert k >= 1000 or k == 0 or t == sorted(values)[-k]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[500:540] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = []
    for q in range(0, 3000, 20):
        g = x @ x[q]
        g[q] = -9
        mine = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - g[r.vec_id]) < 1e-12 for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hits.append(len({r.vec_id for r in mine} & set(np.lexsort((np.arange(3000), -g))[:20])) / 20)
    assert np.mean(hits) > 0.9
    assert {r.vec_id for r in found[500]} == set(range(501, 521))
    assert neighbours.nearest(spark.createDataFrame(rows[3000:], "vec_id long, embedding array<double>")).count() == 0


def test_driver_holds_no_tokenizer(spark, monkeypatch):
    import tokenizers

    class Refused:
        @staticmethod
        def from_file(path):
            raise AssertionError("the driver loads a tokenizer")

    monkeypatch.setattr(tokenizers, "Tokenizer", Refused)
    got = token_files.token_digest(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].start == 0 and got[1].start == got[0].n_tokens and got[1].n_tokens == 1


def _block(nodes: int, names: int, dim: int):
    """Rows of one block whose nodes name ``names`` vectors each, none twice, as of a table much larger than a block."""
    rng = np.random.default_rng(1)
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("node", pa.int64()), ("other", pa.int64()), ("worst", pa.float32()), ("scale", pa.float32()), ("h", pa.binary())])
    for kind in (0, 1):
        for a in range(0, nodes * names, 2048):
            other = np.arange(a, min(a + 2048, nodes * names))
            n, none = len(other), pa.nulls(len(other), pa.float32())
            h = pa.array([x.tobytes() for x in rng.normal(size=(n, dim)).astype(np.float16)], pa.binary()) if kind else pa.nulls(n, pa.binary())
            worst, scale = (pa.array(np.full(n, -np.inf, np.float32)), pa.array(np.ones(n, np.float32))) if kind else (none, none)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(other // names if not kind else other * 0), pa.array(other), worst, scale, h], schema=schema)


def test_neighbours_block_memory():
    """A block as large as blocks get stays within 300 MB of NumPy's and Python's memory."""
    dim = 64
    nodes = neighbours.BLOCK_BYTES // (2 * neighbours.K * 2 * dim)
    tracemalloc.start()
    try:
        sent = sum(sum(len(v) // 8 for v in batch.column(1).to_pylist()) for batch in neighbours._introducing(24, 50)(_block(nodes, 2 * neighbours.K, dim)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == nodes * 2 * neighbours.K * 12 and peak < 300 << 20, (sent, peak)


def test_neighbours_sent_early(monkeypatch):
    """Introductions sent before a block ends are the same as those sent at its end."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 0)

    def found(held):
        monkeypatch.setattr(neighbours, "HELD", held)
        sent = list(neighbours._introducing(24, 3)(_block(40, 16, 8)))
        lists = list(neighbours._collecting(pa.Table.from_batches(sent).sort_by("bucket").to_batches(max_chunksize=4)))
        return len(sent), {n: (i, s) for b in lists for n, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    (once, want), (often, got) = found(1_000_000), found(300)
    assert once == 1 and often > 5 and got == want and len(got) == 640


def test_sharding_sql(spark, sf):
    """All columns but the checksum, which DuckDB doesn't have."""
    compare(spark, sf, QUERIES["op5_sharding"], sharding.SQL)


def test_sharding(spark, docs):
    got = sharding.shard_by_bytes(docs, shards=7).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    for shard, rows in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in rows] == list(range(sum(r.shard == shard for r in got)))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 4 * max(r.size for r in got)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs, block=16).collect()
    for source in {(r.source_size, r.target) for r in got}:
        taken = sum(r.taken for r in got if (r.source_size, r.target) == source)
        assert abs(taken - source[1]) <= 2 and source[1] <= 3 * source[0]
    assert all(r.taken <= 3 * r.size for r in got) and len(got) == docs.count()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs, block=16).collect())
    rows = mixing.mixed_rows(docs, block=16)
    words = sum(len((r.text or "").split()) for r in rows.collect())
    assert rows.columns == docs.columns and words == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


ODD = [(5, None), (7, ""), (9, "a  b\n\n c\t d e  x \x1c y \x85z"), (3, "<|endoftext|> a <|endoftext|>b"), (11, "don't  I'll 'x 12 4,5"), (2, "\U0001f600 é́ x\n\n\ny"), (21, " "), (22, "x" * 5000 + " " + "y " * 3000), (-4, "\n\r\n a"), (30, "a\nb\n\nc d"), (34, "a\u00a0b\u3000c"), (None, "n"), (30, "a\nb\n\nc d")]


@pytest.mark.parametrize("sizes", [[200, 40_000], [1, 3, 17, 90_000, 250]])
def test_mixing_tiny_sources(spark, sizes):
    rows = [(100 * i + j, " ".join(["w"] * (n // 4 + (n % 4 if j == 0 else 0))), "en", f"s{i}", 0) for i, n in enumerate(sizes) for j in range(4)]
    block = 8 if len(sizes) > 2 else 1024
    filler = [(10_000 + i, "w w w", "en", f"t{i}", 0) for i in range(20)] if block == 1024 else []
    got = {}
    for r in mixing.mix(spark.createDataFrame(rows + filler, DOCS), block=block).collect():
        source = r.doc_id if r.doc_id >= 10_000 else r.doc_id // 100
        goal, taken = got.get(source, (0, 0))
        got[source] = int(r.target), taken + r.taken
    assert all(goal == taken for goal, taken in got.values()), got
    sized = spark.createDataFrame([("a", 100, 1, 300.0), ("b", 10**9, 2, 10.0**9)], "source string, source_size long, source_no int, target double")
    slots = mixing.schedule(sized, 1024).where("source_no = 1").collect()
    assert sorted(r.r for r in slots) == [0, 1, 2]


def test_mix_in_plans_of_their_own(spark):
    """What the driver plans last joins saved tables; with the schedule in it, sf0.01 gave it 20 exchanges."""
    got = mixing.mixed_rows(spark.createDataFrame(small_docs(), DOCS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 9, plan


def test_schedule_in_plans_of_its_own(spark):
    """One plan of the schedule held its windows and its slots up to six times."""
    sized = spark.createDataFrame([("a", 100, 1, 300.0), ("b", 10**6, 2, 10.0**6)], "source string, source_size long, source_no int, target double")
    plan = mixing.schedule(sized, 1024)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange ") <= 5, plan


def test_comparing_reads_data_once(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "a long, b long")
    data = spark.createDataFrame([(i, bytes([i])) for i in range(1, 5)], "id long, data binary")
    got = jaccard_join.compare(pairs, jaccard_join.map_batches(data, lambda batches: batches, "id long, data binary"), lambda x, y: x[0] + y[0] != 4)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 2), (4, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_components_of_stars_and_chains(spark):
    edges = [(1, 2), (1, 3), (9, 7), (7, 5), (5, 11), (11, 12), (20, 21), (30, 31), (31, 30), (40, 40)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c")
    want = {1: 1, 2: 1, 3: 1, 20: 20, 21: 20, 30: 30, 31: 30} | dict.fromkeys([5, 7, 9, 11, 12], 5)
    assert sorted((r.node, r.root) for r in got.collect()) == sorted(want.items())
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_saved_tables_are_only_their_rows(spark):
    scratch = Scratch(spark, "test")
    assert scratch.save(spark.range(3), "t").count() == 3
    assert not any(name.startswith("_") for name in os.listdir(scratch.path("t").removeprefix("file://")))


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    got = sorted(token_files.token_digest(spark.createDataFrame(ODD, "doc_id long, text string"), TOKENIZER).collect(), key=lambda r: r.start)
    for (doc, text), r in zip(sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == tuple(r)
        start += len(ids)
    assert token_files.token_digest(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


@pytest.mark.parametrize("kept", [2, 40, 800_000])
@pytest.mark.parametrize("alike", [False, True])
def test_pieces_kept(monkeypatch, kept, alike):
    """Whatever is kept between batches, and however many pieces share a key, ids are the library's."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE", kept)
    if alike:
        monkeypatch.setattr(token_files, "_piece_keys", lambda pieces: pc.binary_length(pieces).to_numpy().astype(np.uint64) % 3)
    tokenizer, encoder, rng = Tokenizer.from_file(TOKENIZER), token_files.PieceEncoder(TOKENIZER, 2, 0), random.Random(kept)
    words = ["a", "the", "Wörter", "don't", "x" * 8, "x" * 16, "x" * 17 + "y", "x" * 9 + "z" + "x" * 8, "日本語", "é" * 40, "q" * 70, "%%%", "42"] + [f"w{i}" for i in range(60)]
    for _ in range(12):
        texts = ["".join(w + rng.choice([" ", " ", "\n", "\n\n", "  ", "\t"] if i % 3 == 0 else [" ", " ", "\n", "\n\n"]) for w in rng.choices(words, k=rng.randrange(30))) + rng.choice(words) for i in range(20)]
        texts += [None, "", " ", "\n", "\x00a b", "a \x00b", " \x00", "\x1c b"]
        got = encoder.encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        assert len(encoder.cache.pieces) <= kept and len(encoder.cache.keys) == len(encoder.cache.pieces) == len(encoder.cache.used) == len(encoder.cache.ends) - 1


def test_pieces_kept_in_little_memory():
    """A million pieces take a worker about 165 MB beside the tokenizer; as Python strings they took 250 MB."""
    code = f"""
import re, resource, sys
import numpy as np, pyarrow as pa
from lattica.llm import token_files
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
encoder = token_files.PieceEncoder({TOKENIZER!r}, 2, 0)
before = peak()
for i in range(4):
    n = np.random.default_rng(i).integers(10**8, 10**9, 250_000).astype(str)
    encoder.encode(pa.array([" ".join(n[k : k + 250]) for k in range(0, len(n), 250)]))
print(peak() - before)
"""
    took = int(subprocess.run([sys.executable, "-c", code], env=os.environ | {"TOKENIZERS_PARALLELISM": "false", "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}, capture_output=True, text=True, check=True).stdout)
    assert took < 205, took


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 3000).astype("<u2")
    seen, counts = np.unique(ids, return_counts=True)
    lengths = token_files.code_lengths(dict(zip(seen.tolist(), counts.tolist())), 12)
    assert max(lengths.values()) <= 12 and sum(2.0**-x for x in lengths.values()) <= 1
    code = token_files.CanonicalCode(lengths)
    sizes, back = token_files.unpack_block(token_files.pack_block(ids, [n], *code.encoder(3000)), code.table(), code.longest)
    assert sizes.tolist() == [n] and (back == ids).all()


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"broadcast_rows": 0}), (3, {"list_rows": 2}), (4, {"list_rows": 2, "broadcast_rows": 0})])
def test_jaccard_join(spark, seed, options):
    rows = small_docs(seed, 80)
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(40)]
    for i in range(60):  # a group of near copies, some beyond reach of others
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = f"u{i}"
        rows.append((2000 + i, " ".join(w), "en", "s0", 1))
    for i in range(80):  # short sets, from a few words
        rows.append((3000 + i, " ".join(rng.choices("abc", k=rng.choice([2, 4, 5, 8, 9, 10]))), "en", "s0", 1))
    df = spark.createDataFrame(rows, DOCS)
    want = brute_components([(r[0], r[1]) for r in rows])
    got = jaccard_join.link_components(df, **options).collect()
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    kept = jaccard_join.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} and kept.columns == df.columns
    assert jaccard_join.link_components(df.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if (kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "1.2 3-", "+1() .-5", "a1@.+ -_%b"])
def test_pii_base(alphabet):
    rng = random.Random(alphabet)
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert pii.spans_of(text) == brute_spans(text)


@pytest.mark.parametrize(("text", "found"), [("mail john [at] example (dot) com", "john [at] example (dot) com"), ("j.d at mail dot example dot com", "j.d at mail dot example dot com"), ("call plus one two three five five five zero one two three", "plus one two three five five five zero one two three"), ("jоhn@exаmple.com", "jоhn@exаmple.com"), ("4\u200b111 1111 1111 1111", "4\u200b111 1111 1111 1111"), ("look at this dot", None), ("at five or six", None), ("we met at noon. dot com", None)])
def test_pii_disguised(text, found):
    spans = pii.all_spans(text, pii.spans_of(text))
    assert [text[a:b] for a, _, b in spans] == ([found] if found else [])


@pytest.mark.parametrize(("text", "found"), [("host one nine two dot one six eight dot zero dot one is up", "one nine two dot one six eight dot zero dot one"), ("at one zero.two.3.four", "one zero.two.3.four"), ("mail john.doe at example.com now", "john.doe at example.com"), ("see us at example.com", None), ("one dot two dot three", None), ("nine nine nine dot one dot one dot one", None)])
def test_pii_spoken(text, found):
    assert pii.spans_of(text) == [] or found is None
    assert [text[a:b] for a, _, b in pii.all_spans(text, pii.spans_of(text))] == ([found] if found else [])


def test_pii_rows(spark, docs):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == docs.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert "<email>" in pii.mask("x a@b.c y") and pii.mask_pii(docs).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_decontamination_slices(spark, docs):
    items = spark.createDataFrame([(1, docs.where("doc_id = 16").first().text), (2, "w1"), (3, None), (4, "..."), (None, "w2")], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.report(docs, items).collect()), key=repr)
    assert one == sorted(map(tuple, decontaminate.report(docs, items, slice_bytes=8).collect()), key=repr)
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in one)
    cut = decontaminate.remove_contaminated(docs, items, how="spans")
    assert cut.count() == docs.count() and decontaminate.report(cut.where("text is not null"), items).where("contaminated and n_words < 3").count() == 0
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_decontamination_null_item(spark, tmp_path):
    long = " ".join(f"q{i}" for i in range(14))
    texts = [f"a {long} b", "x y q1 q2", "some words of item two", long, None, "nothing here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(None, long), (None, "words of item"), (2, "item two"), (3, f"{long} z")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in decontaminate.op10_decontamination(spark, str(tmp_path)).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(6)] == [(14, 2, True), (0, 0, False), (4, 2, True), (14, 2, True), (0, 0, False), (0, 0, False)]
    assert got[2].items_sha256 == hashlib.sha256(b"2").hexdigest()
    sql = duckdb.connect()
    for name in ("documents", "benchmark"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got.values())) == sorted(sql.execute(decontaminate.SQL).fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows, before = out.collect(), {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in rows} <= before
        if i == 1:
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c in want.values()})
        docs = spark.createDataFrame(rows, docs.schema)
    assert C.STAGES[-1][1](spark, docs, sf).count() == docs.count()
