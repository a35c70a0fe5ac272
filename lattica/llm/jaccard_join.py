"""Jaccard join of word shingles, size-aware: subsets of small sets, inverted lists of large ones.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets of sizes s and t are
linked when their intersection is at least c = ceil(3 (s + t) / 7), which is what a similarity of
0.75 or more means. Sets alike are one class, joined through its smallest doc_id.

Light side: two linked sets share a subset of exactly c shingles, so each set of at most ``bound``
shingles names all its c-subsets, for each c that a partner could ask for. Heavy side: larger sets
enter inverted lists with the first s - ceil(0.75 s) + 1 of their shingles, the rarest first, which
two linked sets can't miss each other in; small sets large enough to have a large partner enter
too. ``bound`` is where the counted cost of both sides is least. Rarity is a count in a sketch of
all shingles of all documents: passages that many documents share are found there and move to the
end. It only decides an order, the same for all sets, so collisions in the sketch cost time and no
link.

Place bound: at the first shingle that two sets share in that order, nothing before it is shared, so
the intersection is at most the smaller of what each set has from there on. A pair meets that bound
there, or nowhere and isn't linked. It holds for a row alone, too: one that has less left than the
smallest set of its list asks for leaves the list. Members of a group of near copies that differ
too much lose their rows this way, before any pair is made.

Links, not all pairs: the product is components. First every list names one centre, the member in
which the fewest rarer shingles come before (of near copies the one most like the others), and each
document is verified against the centre that most of its lists name: a group of copies of any size
costs a pair for each member. Then the pairs of different components that the place bound leaves are
verified, all of them, so no link is lost. Verifying is a bitmap bound, then the exact intersection.
Lists of shingles that the sketch knows to be very frequent are dealt to several tasks by salt where
centres are named; the last join leaves uneven lists to adaptive execution.

Defined cases: null or empty text, or one without words, has size 0, is linked with nothing and is
its own component; with fewer than five words the whole sequence is the only shingle; repeated rows
are alike and share a component; rows of one doc_id with different texts are one document, which has
the links of all of them; null doc_id never links and keeps a null component; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, forget, map_batches, partitions
from lattica.llm.components import components
from lattica.llm.words import mixed, rolled, word_hashes

WORDS = 5
SKETCH = 1 << 22  # counters
SPARE = 64  # rows of the sketch that travel as one
MOST_LIGHT = 16  # sets beyond this size have too many subsets at any cost
LIST_ROWS = 50_000  # rows of one list that a task should see where centres are named
_SUBSET = np.uint64(0xA0761D6478BD642F)
SET_ROWS = 1000  # pairs of one centre that go to one place


def needed(s: int, t: int) -> int:
    """Least intersection of linked sets of sizes s and t: 100 i >= 75 (s + t - i)."""
    return -(-3 * (s + t) // 7)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out = []
    for h in word_hashes([t and t.lower() for t in texts]):  # of bytes: only A-Z change
        if 0 < len(h) < WORDS:
            h = rolled(np.concatenate((h, np.full(1, len(h), np.uint64))), len(h) + 1)
        else:
            h = np.unique(rolled(h, WORDS))
        out.append(h)
    return out


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(42)).astype(np.int64)


def _measuring(batches):
    """Size and digest of each set, and at the end the task's sketch."""
    sketch, any_row = np.zeros(SKETCH, np.uint32), False
    names = ["doc_id", "t", "n", "digest", "place", "counts"]
    for batch in batches:
        sets, n, any_row = shingle_sets(batch.column(1).to_pylist()), batch.num_rows, True
        for s in sets:
            np.add.at(sketch, counter_of(s), 1)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if any_row:
        step = SKETCH // SPARE
        parts = [sketch[i * step : (i + 1) * step].tobytes() for i in range(SPARE)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SPARE, pa.int64()), pa.nulls(SPARE, pa.int64()), pa.nulls(SPARE, pa.int32()), pa.nulls(SPARE, pa.binary()), pa.array(range(SPARE), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _adding(batches):
    """Sums sketches by place; rows come sorted by place."""
    place, total = None, None
    for batch in batches:
        for p, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(counts, np.uint32)
            if p == place:
                total = total + new
                continue
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["place", "counts"])
            place, total = p, new
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["place", "counts"])


class Rarity:
    """Classes of doubling counts, one byte a counter; ``salts`` says over how many tasks a class's lists are dealt."""

    def __init__(self, classes: np.ndarray, usual: float, list_rows: int):
        self.classes = classes
        self.salts = np.ceil(usual * 2 ** (np.arange(256) / 2).clip(max=60) / list_rows).astype(np.int64)
        self.salts[0] = 1

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.classes[counter_of(s)]


def _classing(usual: float):
    """Summed counts to classes; those that chance alone explains are one class."""

    def run(batches):
        for batch in _adding(batches):
            found = [np.ceil(np.log2(np.maximum(np.frombuffer(x, np.uint32), usual) / usual) * 2).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["place", "counts"])

    return run


def rarity(measured: DataFrame, list_rows: int) -> Rarity:
    """From the sum of all tasks' sketches."""
    n = partitions(measured)
    mean = float(measured.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / SKETCH
    usual = mean + 4 * mean**0.5 + 2
    rows = measured.where("place is not null").select("place", "counts").repartition(n).sortWithinPartitions("place")
    rows = map_batches(rows, _adding, "place int, counts binary")  # one row a place and task
    rows = map_batches(rows.repartition(SPARE, "place").sortWithinPartitions("place"), _classing(usual), "place int, counts binary")
    out = np.zeros(SKETCH, np.uint8)
    step = SKETCH // SPARE
    for row in rows.collect():  # 4 MB, whatever the input
        out[row["place"] * step : (row["place"] + 1) * step] = np.frombuffer(row["counts"], np.uint8)
    return Rarity(out, usual, list_rows)


def light_cost(s: int) -> int:
    return sum(comb(s, c) for c in range(ceil(0.75 * s), s + 1))


def prefix_length(s: int) -> int:
    return s - ceil(0.75 * s) + 1


def choose_bound(sizes: dict[int, int]) -> int:
    """The bound between light and heavy at which fewest rows are made. ``sizes``: documents by size, up to 64."""
    def cost(bound: int) -> int:
        light = sum(n * light_cost(s) for s, n in sizes.items() if s <= bound)
        return light + sum(n * prefix_length(s) for s, n in sizes.items() if s >= ceil(0.75 * (bound + 1)))

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def subset_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each subset of each size that a partner of this set or of a smaller or larger one could ask for, and its size."""
    out, sizes = [], []
    n = len(s)
    for c in range(ceil(0.75 * n), n + 1):
        picked = np.array(list(combinations(range(n), c)))
        h = np.full(len(picked), c, np.uint64)
        for k in range(c):
            h = mixed(h * _SUBSET + s[picked[:, k]])
        out.append(h)
        sizes.append(np.full(len(h), c))
    return np.concatenate(out), np.concatenate(sizes)


def _listing(order_of, bound: int):
    """Rows (key, salt, at, id, n): at is the shingle's place in the set's order, or -c for a subset of c. Salt 0: one task has the whole list."""

    def run(batches):
        order = order_of.value
        for batch in batches:
            columns = [[] for _ in range(5)]
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                n = len(s)
                found = []
                if 0 < n <= bound:
                    k, c = subset_keys(s)
                    found.append((k, np.zeros(len(k), np.int32), -c.astype(np.int32)))
                if n and n >= ceil(0.75 * (bound + 1)):
                    kinds = order.of(s)
                    first = np.lexsort((s, kinds))[: prefix_length(n)]
                    tasks = order.salts[kinds[first]]
                    salt = np.where(tasks > 1, 1 + doc * 0x9E3779B97F4A7C15 % (1 << 31) % tasks, 0)
                    found.append((s[first], salt.astype(np.int32), np.arange(len(first), dtype=np.int32)))
                for k, salt, at in found:
                    for column, x in zip(columns, (k.view(np.int64), salt, at, np.full(len(k), doc, np.int64), np.full(len(k), n, np.int32)), strict=True):
                        column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "salt", "at", "id", "n"])

    return run


_LISTED = "key long, at int, id long, n int, c_at int, c_id long, c_n int"


def _shared(batches):
    """Rows sorted by (key, salt, at, id): those whose key stands in more than one, with the first as centre. Rows of a salted key all stay."""
    names = [f.split()[0] for f in _LISTED.split(", ")]
    held, of = None, None  # the last row so far and whether it is shared; its key's first row
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(5)]
        if not len(cols[0]):
            continue
        shared = False
        if held is not None:
            cols, shared = [np.concatenate((h, c)) for h, c in zip(held[0], cols, strict=True)], held[1]
        key, salt, at, doc, n = cols
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        starts = np.concatenate(([True], ~same))
        keep = np.concatenate((same, [False])) | np.concatenate(([shared], same)) | (salt > 0)
        group = np.cumsum(starts) - 1
        centres = [x[starts] for x in (at, doc, n)]
        if held is not None:  # the first row goes on the group of the last batch
            for x, old in zip(centres, of, strict=True):
                x[0] = old
        held, of = ([c[-1:] for c in cols], bool(keep[-1])), [x[-1] for x in centres]
        out = np.flatnonzero(keep[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, at, doc, n)] + [pa.array(x[group[out]]) for x in centres], names=names)
    if held is not None and held[1]:
        key, _, at, doc, n = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, at, doc, n)] + [pa.array(np.array([x])) for x in of], names=names)


def _outlines(batches):
    """Set size and bitmap: a bit for each value of the hashes' low bits, at least four times as many as shingles."""
    for batch in batches:
        out = []
        for s in shingle_sets(batch.column(1).to_pylist()):
            bits = max(64, 1 << (4 * len(s) - 1).bit_length())
            bitmap = np.zeros(bits, np.uint8)
            bitmap[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
            out.append(len(s).to_bytes(4, "little") + np.packbits(bitmap).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "data"])


def _sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "data"])


def _enough(common: int, s: int, t: int) -> bool:
    return 100 * common >= 75 * (s + t - common)


def may_link(x: bytes, y: bytes) -> bool:
    """Whether outlines allow a link. Each bit in which they differ takes a shingle that only one set has."""
    s, t = int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little")
    a, b = int.from_bytes(x[4:], "little"), int.from_bytes(y[4:], "little")
    p, q = len(x) - 4, len(y) - 4
    while p > q:  # fold the finer bitmap: its upper half onto the lower one
        p //= 2
        a = (a >> (8 * p)) | (a & ((1 << (8 * p)) - 1))
    while q > p:
        q //= 2
        b = (b >> (8 * q)) | (b & ((1 << (8 * q)) - 1))
    return _enough((s + t - (a ^ b).bit_count()) // 2, s, t)


def links(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    small, big = (a, b) if len(a) < len(b) else (b, a)
    where = np.searchsorted(big, small)
    return _enough(int((big[np.minimum(where, len(big) - 1)] == small).sum()), len(a), len(b))


def _comparing(test):
    """Rows sorted by (a, salt, b nulls first): a centre's own data, then those to compare with it."""

    def run(batches):
        at, own = None, []  # an id with several texts has several data
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if b is None:
                    at, own = (a, salt), own + [data] if at == (a, salt) else [data]
                elif at != (a, salt):
                    raise ValueError("a centre's data is missing")
                elif any(test(x, data) for x in own):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def compare(pairs: DataFrame, data: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose data pass the test. A centre's many partners are dealt to places by salt, each with the centre's data."""
    n = partitions(pairs)
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SET_ROWS).cast("int").alias("salts"))
    others = pairs.join(counts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    own = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    rows = others.unionByName(own).join(data, "id").select("a", "salt", "b", "data")  # one join, as the plan holds the data's own for each
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return map_batches(rows, _comparing(test), "a long, b long")


def _possible(x: str, y: str) -> str:
    """Sizes and places that linked sets could have at the first key that they share."""
    need = f"ceil(3 * ({x}n + {y}n) / 7)"
    sizes = f"least({x}n, {y}n) * 4 >= greatest({x}n, {y}n) * 3"
    return f"{sizes} and if({x}at < 0, -{x}at, least({x}n - {x}at, {y}n - {y}at)) >= {need}"


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set) for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    n = partitions(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))  # with doc_id, the row's name
    measured = scratch.save(map_batches(docs.select("doc_id", "text", "t"), _measuring, "doc_id long, t long, n int, digest binary, place int, counts binary"), "measured")
    order = spark.sparkContext.broadcast(rarity(measured, list_rows))
    rows = measured.where("place is null").select("doc_id", "t", "n", "digest")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = scratch.save(rows.join(classes, "digest", "left").select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "members")
    scratch.drop("measured")
    sizes = members.where("doc_id = class_id and n <= 64").groupBy("n").count()
    bound = choose_bound({r["n"]: r["count"] for r in sizes.collect()})
    # Copies whose set is a smaller id's stay out; where all rows are distinct this keeps every row.
    copies = members.where("class_id is not null and doc_id <> class_id").select("doc_id", "t")
    firsts = docs.where("doc_id is not null").join(_small(copies, broadcast_rows), ["doc_id", "t"], "left_anti").select("doc_id", "text")
    lists = map_batches(firsts, _listing(order, bound), "key long, salt int, at int, id long, n int")
    lists = scratch.save(map_batches(lists.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "at", "id"), _shared, _LISTED), "lists")
    order.destroy()  # of the driver's memory too
    forget(spark)

    def ends_of(pairs: DataFrame) -> DataFrame:
        """The documents that pairs name, with all their texts: each is the document's."""
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        return docs.join(_small(ids, broadcast_rows, 2 * pairs.count()), "doc_id", "left_semi").select("doc_id", "text")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """A bitmap bound, then exact on what that leaves."""
        near = scratch.save(compare(pairs, map_batches(ends_of(pairs), _outlines, "id long, data binary"), may_link), f"near-{name}")
        found = scratch.save(compare(near, map_batches(ends_of(near), _sets, "id long, data binary"), links), f"links-{name}")
        scratch.drop(f"near-{name}")
        forget(spark)
        return found

    # Rows of one id with several classes: the same document.
    several = members.where("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z").select("doc_id", "a")
    own = members.where("class_id is not null").join(several, "doc_id").where("class_id > a").select("a", F.col("class_id").alias("b")).distinct()
    # Each document with the centre that most of its lists name.
    named = lists.where("id <> c_id").where(_possible("", "c_")).groupBy(F.col("id").alias("b"), F.col("c_id").alias("a")).count()
    pairs = scratch.save(named.groupBy("b").agg(F.max_by("a", F.struct("count", F.negative("a"))).alias("a")).select("a", "b"), "centre-pairs")
    found = verify(pairs, "centres")
    roots = scratch.save(components(own.unionByName(found), scratch, "first-"), "roots")
    # Pairs of different components that their places allow, in lists that hold several.
    rooted = lists.select("key", "at", "id", "n").join(_small(roots, broadcast_rows), lists["id"] == roots["node"], "left").select("key", "at", "id", "n", F.coalesce("root", "id").alias("root"))
    heads = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("key", "least")
    least = "greatest(least, ceil(3 * n / 4))"
    left = scratch.save(rooted.join(heads, "key").where(f"at < 0 or n - at >= ceil(3 * (n + {least}) / 7)").drop("least"), "left")
    scratch.drop("lists", "centre-pairs", "links-centres")
    forget(spark)
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, F.expr("x.key = y.key and x.id < y.id and x.root <> y.root and " + _possible("x.", "y.")))
    rest = scratch.save(rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "rest")
    scratch.drop("left")
    last = verify(rest, "last")
    if not last.isEmpty():
        roots = scratch.save(components(_tied(roots).unionByName(last), scratch, "final-"), "final-roots")
    out = members.join(_small(roots, broadcast_rows), members["class_id"] == roots["node"], "left")
    out = scratch.save(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), "out")
    scratch.keep_only("out")
    return out


def _small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Broadcast behind a count of the rows (ids of 8 bytes); else a shuffle. ``most``: a bound of that count, which may spare it."""
    return F.broadcast(df) if most is not None and most <= rows or df.count() <= rows else df


def _tied(roots: DataFrame) -> DataFrame:
    """Components so far as edges: each node with its root."""
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The input's columns: of each component the row with the smallest doc_id; rows of size 0 or null doc_id all stay."""
    gone = link_components(docs, **options).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(_small(gone, 1_000_000), "doc_id", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir):
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)
), r AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
