"""Approximate nearest neighbours by NN-descent, with greedy search over the graph.

Building: random-hyperplane trees, fitted on a bounded sample and applied to every row, deal the
vectors into cells of at most ``cell`` rows; exact neighbours within the cells of ``trees`` trees
start the graph. Each round of NN-descent lets every node introduce its neighbours (the nodes it
points to and a bounded sample of those pointing to it) to each other: nodes are dealt to blocks
of bounded size, each block fetches the distinct vectors its nodes name (a vector goes to no more
blocks than there are, nor than name it), as half-precision numbers and a scale, compares them pair
by pair in NumPy, and sends back for each vector only introductions better than its present worst
neighbour. Lists of candidates are merged per node. Work a round is proportional to the number of
nodes. What a task holds depends on BLOCK_BYTES and HELD, not on the number of nodes: introductions
that would exceed them are sent on before the block ends.

Searching: a query is a row, so its node's neighbours start the search; each step expands the best
unexpanded nodes of every query, joins their neighbours in, and keeps the best. The final list is
scored in double precision on the original vectors.

Vectors alike are one node, whose members share its neighbours: a group of copies of any size is
one node, and a query takes from it the smallest ids, of which k + 1 are enough for any answer.

Nearness is the inner product. Vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than the first row's; null ids take no part; repeated
ids with the same vector are one row; ties go to the smaller id; an empty table gives no row. With
fewer candidates than k, all that the search finds are returned; up to ``cell`` distinct vectors
that is all there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, map_batches, partitions

K = 64  # neighbours a node keeps
CELL = 1000
BLOCK_BYTES = 144 << 20  # of halved vectors that a block fetches at most: 2 K for each of its nodes
HELD = 250_000  # introductions that a block's task holds beside its vectors; more where those are fewer
SAMPLE = 20_000
_NODES = "node long, ids binary, scores binary"


def _float_rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    n = len(lists)
    return np.asarray(lists.flatten(), np.float32).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


class Trees:
    """Hyperplanes of some trees, as arrays of (weights, threshold) in heap order."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes = []
        for _ in range(trees):
            weights = rng.normal(size=((1 << depth) - 1, sample.shape[1])).astype(np.float32)
            thresholds = np.zeros(len(weights), np.float32)
            at = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                side = np.einsum("ij,ij->i", sample, weights[at])
                for node in range(first, 2 * first + 1):
                    inside = side[at == node]
                    thresholds[node] = np.median(inside) if len(inside) else 0
                at = 2 * at + 1 + (side > thresholds[at])
            self.planes.append((weights, thresholds))

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for weights, thresholds in self.planes:
            at = np.zeros(len(x), np.int64)
            while len(weights) and at[0] < len(weights):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, weights[at]) > thresholds[at])
            out.append(at)
        return out


def _dealing(trees_of):
    """(tree, cell, node, vector) for each tree."""

    def run(batches):
        trees = trees_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for t, cell in enumerate(trees.cells(_float_rows(batch, 1))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell), batch.column(0), batch.column(1)], names=["tree", "cell", "node", "v"])

    return run


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _best_of(g: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    return np.argpartition(-g, k - 1, axis=1)[:, :k] if g.shape[1] > k else np.broadcast_to(np.arange(g.shape[1]), g.shape)


def _node_rows(nodes, lists) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([np.asarray(i, np.int64).tobytes() for i, _ in lists], pa.binary()), pa.array([np.asarray(s, np.float32).tobytes() for _, s in lists], pa.binary())],
        names=["node", "ids", "scores"],
    )


def _groups(batches, keys: int):
    """Rows that agree in the first ``keys`` columns, which they are sorted by, as one batch each; groups are bounded by their making."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            this = tuple(c[a] for c in columns)
            if held and this != key:
                whole, held = pa.Table.from_batches(held), []
                yield key, whole.combine_chunks().to_batches()[0]
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cell_neighbours(batches):
    for _, cell in _groups(batches, 3):
        nodes, x = cell.column(3).to_numpy(), _float_rows(cell, 4)
        for a in range(0, len(nodes), 512):
            g = x[a : a + 512] @ x.T
            g[np.arange(len(g)), np.arange(a, a + len(g))] = -np.inf
            best = _best_of(g, K)
            lists = [_top(nodes[b[g[i, b] > -np.inf]], g[i, b[g[i, b] > -np.inf]], K) for i, b in enumerate(best)]
            yield _node_rows(nodes[a : a + 512], lists)


def _merging_lists(batches):
    """Rows sorted by node: each node's best K of all its rows."""
    for batch in batches_by_node(batches):
        nodes, lists = [], []
        node = batch.column(0).to_numpy()
        ids, scores = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            nodes.append(node[a])
            lists.append(_top(np.frombuffer(b"".join(ids[a:b]), np.int64), np.frombuffer(b"".join(scores[a:b]), np.float32), K))
        yield _node_rows(nodes, lists)


def batches_by_node(batches):
    """Batches cut between nodes."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        node = batch.column(0).to_numpy()
        last = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield held


def merge_lists(rows: DataFrame) -> DataFrame:
    return map_batches(rows.repartition(partitions(rows), "node").sortWithinPartitions("node"), _merging_lists, _NODES)


def _naming(batches):
    """From each node's list: (node, other) as pointed to, and (other, node) as pointing, with a random turn."""
    for batch in batches:
        node, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        to = np.frombuffer(b"".join(ids), np.int64)
        of = np.repeat(node, [len(i) // 8 for i in ids])
        turn = (of * 0x9E3779B1 + to * 0x85EBCA77) & 0x7FFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((of, to))), pa.array(np.concatenate((np.zeros(len(of), np.int64), turn + 1))), pa.array(np.concatenate((to, of)))], names=["node", "turn", "other"])


def _bucket(node: np.ndarray, buckets: int) -> np.ndarray:
    return ((node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _shrink(state, found, most: int):
    """The ``most`` best distinct w of each v, sorted by v."""
    v, w, s = (np.concatenate([old, *new]) for old, new in zip(state, found, strict=True))
    order = np.lexsort((w, -s, v))
    v, w, s = v[order], w[order], s[order]
    new = np.concatenate((np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    v, w, s = v[new], w[new], s[new]
    rank = np.arange(len(v)) - np.searchsorted(v, v)
    return v[rank < most], w[rank < most], s[rank < most]


def _no_state():
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)


def _collecting(batches):
    """A bucket's introductions, packed by the blocks that made them: the best K of each of its nodes. Rows are read one by one, so that a bucket's nodes bound what is held."""
    kinds = np.int64, np.int64, np.float32
    empty = lambda: [bytearray() for _ in kinds]

    def shrunk(state, found):
        return _shrink(state, [[np.frombuffer(x, k)] for x, k in zip(found, kinds, strict=True)], K)

    def best(state, found):
        v, w, s = shrunk(state, found)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)] if len(v) else [0]
        return _node_rows(v[cuts[:-1]], [(w[a:b], s[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    key, state, found = None, _no_state(), empty()
    for batch in batches:
        for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != key:
                if key is not None:
                    yield best(state, found)
                key, state, found = bucket, _no_state(), empty()
            for x, part in zip(found, parts, strict=True):
                x += part
            if len(found[0]) > 4 * 8 * HELD:
                state, found = shrunk(state, found), empty()
    if key is not None:
        yield best(state, found)


def _halving(batches):
    """node, v as half-precision numbers of its largest component, and that component."""
    for batch in batches:
        x = _float_rows(batch, 1)
        scale = np.abs(x).max(1, initial=0)
        scale = np.where((scale > 0) & np.isfinite(scale), scale, np.float32(1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in (x / scale[:, None]).astype(np.float16)], pa.binary()), pa.array(scale)], names=["node", "h", "scale"])


def _blocks(batches):
    """Of each block, whose rows come as _introducing has them: other of its names, and where their nodes change; other, worst, scale and halves of its vectors. Columns are views of what has grown, so nothing is held twice."""
    kinds = np.int64, np.int64, np.float32, np.float32, np.float16
    empty = lambda: ([0], [bytearray() for _ in kinds])

    def whole(cuts, parts):
        names, ids, worst, scale, halves = (np.frombuffer(x, k) for x, k in zip(parts, kinds, strict=True))
        return [*cuts, len(names)], names, ids, worst, scale, halves.reshape(len(ids), -1) if len(ids) else halves.reshape(0, 0)

    key, last, (cuts, parts) = None, None, empty()
    for batch in batches:
        block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(change[:-1], change[1:], strict=True):
            if block[a] != key:
                if key is not None:
                    yield whole(cuts, parts)
                key, last, (cuts, parts) = block[a], None, empty()
            node, other, worst, scale, h = (batch.column(i).slice(a, b - a) for i in range(2, 7))
            if kind[a] == 0:
                node, at = node.to_numpy(), len(parts[0]) // 8
                if last is not None and last != node[0]:
                    cuts.append(at)
                cuts += (np.flatnonzero(node[1:] != node[:-1]) + 1 + at).tolist()
                last = node[-1]
                parts[0] += other.to_numpy().tobytes()
            else:
                for part, column in zip(parts[1:], (other, worst, scale), strict=False):
                    part += column.to_numpy().tobytes()
                parts[4] += b"".join(h.to_pylist())
    if key is not None:
        yield whole(cuts, parts)


def _introducing(most: int, buckets: int):
    """A block's rows: names (node, other) and then vectors (other, its worst score, scale, h). Better introductions, by vector."""
    def packed(ids, v, w, s):
        v, w = ids[v], ids[w]
        bucket = _bucket(v, buckets)
        order = np.argsort(bucket, kind="stable")
        v, w, s, bucket = v[order], w[order], s[order], bucket[order]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(v)] if len(v) else [0]
        parts = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (v, w, s)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *[pa.array(x, pa.binary()) for x in parts]], names=["bucket", "v", "w", "s"])

    def run(batches):
        for cuts, names, ids, worst, scale, halves in _blocks(batches):
            room = HELD + max(0, BLOCK_BYTES - halves.nbytes) // 64
            found = [[], [], []]
            held = 0
            state = _no_state()

            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                p = np.searchsorted(ids, np.unique(names[a:b]))  # every node has a vector, so each name is found
                if len(p) < 2:
                    continue
                x = halves[p] * scale[p, None]
                g = x @ x.T
                np.fill_diagonal(g, -np.inf)
                best = _best_of(g, 12)
                s = np.take_along_axis(g, best, 1)
                i, j = np.nonzero(s > worst[p][:, None])
                found[0].append(p[i])
                found[1].append(p[best[i, j]])
                found[2].append(s[i, j])
                held += len(i)
                if held > room // 3:
                    state, found, held = _shrink(state, found, most), [[], [], []], 0
                    if len(state[0]) > room:
                        yield packed(ids, *state)
                        state = _no_state()
            yield packed(ids, *_shrink(state, found, most))
            del cuts, names, ids, worst, scale, halves, state, found  # before the next block is gathered

    return run


def _worst(batches):
    for batch in batches:
        full = [len(s) // 4 >= K for s in batch.column(1).to_pylist()]
        low = [np.frombuffer(s, np.float32).min() if f else -np.inf for s, f in zip(batch.column(1).to_pylist(), full, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(low, np.float32))], names=["node", "worst"])


def build_graph(nodes: DataFrame, scratch: Scratch, trees: int = 4, rounds: int = 3, seed: int = 11, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``nodes``: node, v (array<float>). Returns node, ids, scores: its best K neighbours, packed."""
    spark, n_parts = nodes.sparkSession, partitions(nodes)
    n = nodes.count()
    # A share of some 2 SAMPLE rows first, so that the one task that orders them does not see all.
    share = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // (2 * SAMPLE)))) == 0
    sample = nodes.where(share).orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toArrow()
    x = np.asarray(sample["v"].combine_chunks().flatten(), np.float32).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1), np.float32)
    depth = min(12, max(0, int(np.ceil(np.log2(max(1, n / CELL))))))  # 4,096 cells at most; larger ones are dealt on by hash
    shared = spark.sparkContext.broadcast(Trees(x, trees, depth, seed))
    dealt = scratch.save(map_batches(nodes.select("node", "v"), _dealing(shared), "tree int, cell long, node long, v array<float>"), "dealt", "none")
    sizes = dealt.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("subs"))  # trees * 4,096 rows at most
    cells = dealt.join(F.broadcast(sizes), ["tree", "cell"]).select("tree", "cell", F.pmod(F.xxhash64("node", "tree"), F.col("subs")).cast("int").alias("sub"), "node", "v")
    cells = cells.repartition(n_parts, "tree", "cell", "sub").sortWithinPartitions("tree", "cell", "sub")
    graph = scratch.save(merge_lists(map_batches(cells, _cell_neighbours, _NODES)), "graph0", "none")
    scratch.drop("dealt")
    halves = scratch.save(map_batches(nodes.select("node", "v"), _halving, "node long, h binary, scale float"), "halves", "none")
    blocks = max(1, -(-n * 2 * K * 2 * x.shape[1] // block_bytes))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    for i in range(1, rounds + 1):
        named = map_batches(graph.select("node", "ids"), _naming, "node long, turn long, other long")
        # Those pointing to a node are sampled down to K by their turn; a hub's are cut before they move.
        pointing = named.where("turn > 0").withColumn("rank", F.expr("row_number() over (partition by node order by turn, other)")).where(f"rank <= {K}").select("node", "other")
        names = scratch.save(named.where("turn = 0").select("node", "other").unionByName(pointing).withColumn("block", block), f"names{i}")
        worst = map_batches(graph.select("node", "scores"), _worst, "node long, worst float")
        vectors = halves.join(worst, "node").select(F.col("node").alias("other"), "worst", "scale", "h")
        wanted = names.select("block", "other").distinct().join(vectors, "other")
        rows = names.select("block", F.lit(0).alias("kind"), "node", "other", *[F.lit(None).cast(k).alias(c) for c, k in (("worst", "float"), ("scale", "float"), ("h", "binary"))]).unionByName(
            wanted.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("node"), "other", "worst", "scale", "h")
        )
        rows = rows.repartition(max(n_parts, min(blocks, 10 * n_parts)), "block").sortWithinPartitions("block", "kind", "node", "other")
        packed = map_batches(rows, _introducing(24, blocks), "bucket int, v binary, w binary, s binary")
        better = map_batches(packed.repartition(max(n_parts, min(blocks, 10 * n_parts)), "bucket").sortWithinPartitions("bucket"), _collecting, _NODES)
        graph = scratch.save(merge_lists(graph.unionByName(better)), f"graph{i}", "none")
        scratch.drop(f"names{i}", f"graph{i - 1}")
    scratch.drop("halves")
    return graph


def _expanding(step: int, width: int):
    """Rows sorted by (query, kind): the query's pool and vector, then candidates' vectors. The new pool."""

    def run(batches):
        for _, rows in _groups(batches, 1):
            kind = rows.column(1).to_numpy()
            own = int(np.searchsorted(kind, 1))
            pool = rows.slice(0, 1).to_pylist()[0]
            q = np.asarray(pool["v"], np.float32)
            ids, scores = np.frombuffer(pool["ids"], np.int64), np.frombuffer(pool["scores"], np.float32)
            done = np.frombuffer(pool["done"], np.int64)
            new = rows.slice(own)
            if new.num_rows:
                fresh = new.column(2).to_numpy()
                ids, scores = _top(np.concatenate((ids, fresh)), np.concatenate((scores, _float_rows(new, 6) @ q)), width)
            open_ = ids[~np.isin(ids, done)][:step]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).slice(0, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary()), pa.array([np.concatenate((done, open_)).tobytes()], pa.binary()), pa.array([open_], pa.list_(pa.int64())), rows.column(6).slice(0, 1)],
                names=["query", "ids", "scores", "done", "open", "v"],
            )

    return run


def _unpacked(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(i, np.int64) for i in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "ids"])


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, scratch: Scratch, steps: int = 2, step: int = 8, width: int = K) -> DataFrame:
    """``queries``: query (a node), v. Returns query, node of each query's best ``width`` nodes."""
    n = partitions(nodes)
    pools = queries.join(graph, queries["query"] == graph["node"]).select("query", "ids", "scores", F.lit(b"").alias("done"), F.lit(None).cast("array<long>").alias("open"), "v")
    lists = map_batches(graph.select("node", "ids"), _unpacked, "node long, ids array<long>")
    schema = "query long, ids binary, scores binary, done binary, open array<long>, v array<float>"
    for i in range(steps + 1):
        own = pools.select("query", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), "ids", "scores", "done", "v")
        rows = own
        if i:
            opened = pools.select("query", F.explode("open").alias("node"))
            found = opened.join(lists, "node").select("query", F.explode("ids").alias("node")).where("query <> node").distinct()
            vectors = found.join(nodes, "node").select("query", F.lit(1).alias("kind"), "node", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "scores", "done")], "v")
            rows = own.unionByName(vectors)
        rows = rows.repartition(n, "query").sortWithinPartitions("query", "kind", "node")
        pools = scratch.save(map_batches(rows, _expanding(step, width), schema), f"pools{i}", "none")
        if i:
            scratch.drop(f"pools{i - 1}")
    best = map_batches(pools.select(F.col("query").alias("node"), "ids"), _unpacked, "node long, ids array<long>")
    return best.select(F.col("node").alias("query"), F.explode("ids").alias("node"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("d")).where("id is not null and d is not null and size(d) > 0")
    rows = rows.where(F.expr("forall(d, e -> e is not null and not isnan(e) and abs(e) < double('inf')) and exists(d, e -> e <> 0)")).dropDuplicates(["id", "d"])
    size = rows.orderBy("id").select(F.size("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # -0.0 and 0.0 are one value, so that vectors alike have one key.
    rows = scratch.save(rows.where(F.size("d") == size[0]).withColumn("d", F.expr("transform(d, e -> e + 0D)")), "rows")
    groups = rows.groupBy("d").agg(F.min("id").alias("node"))
    members = scratch.save(rows.join(groups, "d").select("id", "node", "d"), "members")
    nodes = scratch.save(members.where("id = node").select("node", F.col("d").cast("array<float>").alias("v")).dropDuplicates(["node"]), "nodes", "none")
    graph = build_graph(nodes, scratch, **options)
    asked = members.where(F.pmod("id", F.lit(every)) == 0).select("id", "node", "d")
    queries = asked.select(F.col("node").alias("query")).distinct().join(nodes, F.col("query") == F.col("node")).select("query", "v")
    found = search(queries, graph, nodes, scratch)
    near = found.unionByName(queries.select("query", F.col("query").alias("node")))
    # Of a node the smallest k + 1 ids are enough: a query takes at most k, and leaves itself out.
    some = members.withColumn("nth", F.expr("row_number() over (partition by node order by id)")).where(f"nth <= {k + 1}").select(F.col("id").alias("vec_id"), "node", "d")
    score = F.expr("aggregate(zip_with(qd, d, (a, b) -> a * b), 0D, (s, p) -> s + p)")
    # Scores are made once for two nodes, not for their members.
    bases = members.where("id = node").select("node", "d")
    pairs = near.join(bases.select("node", "d"), "node").join(bases.select(F.col("node").alias("query"), F.col("d").alias("qd")), "query").select("query", "node", score.alias("score"))
    kept = pairs.withColumn("nth", F.expr("row_number() over (partition by query order by score desc, node)")).where(f"nth <= {3 * k}").select("query", "node", "score")
    answers = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(kept, "query").join(some.select("vec_id", "node"), "node").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = None  # approximate; tests hold recall against brute force
