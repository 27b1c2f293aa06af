"""Approximate nearest neighbours: an NN-descent graph built by joins, searched greedily.

Nearness is the inner product. It favours long vectors, which hardly ever are near in
direction to the rows that look for them; so vectors are put into bands of one doubling
of length each, and a query searches every band that may hold one of its nearest. What a
band of greatest length ``G`` can score is at most ``G`` times the query's length; bands below the
query's ``k``-th score so far are left out, which loses nothing.

1. Equal vectors become one node. Only the smallest ids of a node can be among the
   ``k`` nearest, so a node carries ``k + 1`` of them, whatever the size of its group.
2. First neighbours come from a few orders of each band's nodes by random-hyperplane signs:
   nodes that stand together in blocks of ``BLOCK`` are compared with each other.
3. NN-descent rounds, on the angle between vectors: each node gathers its neighbours and
   some of the nodes that have it as a neighbour (a join by id brings their vectors, in 8 bits
   a component), compares the ones that have not met, and offers each what beats its farthest
   neighbour; a ranking window keeps the ``degree`` nearest. Rounds end when fewer
   than ``LEAST_CHANGE`` of all places changed. Neighbours are of one band.
4. In its own band a query starts at its node's neighbours. Into other bands' orders its vector is put
   as a guest, and starts at what stands nearest there and at ``ENTRIES`` nodes of the band.
   Then it goes on greedily by inner product: the nearest nodes not yet opened are opened,
   their neighbours joined in and scored, until all of its ``BEAM`` nearest in the band have been
   opened. All queries and bands take each step together, as one set of joins.
5. A stated sample of queries is also answered exactly, in one pass. While less than
   ``LEAST_RECALL`` of those answers are found, all beams are doubled and the search goes on.
6. The nearest ``RERANK`` nodes of each band are scored again in double precision with the original vectors.

Each round is written to the checkpoint folder; no link or score reaches the
driver, which only sees counts, the bands, the mean direction and the sample's vectors.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part, nor do null ids or vectors with another length than the
commonest one. Of rows that repeat an id the smallest vector counts. Ties in score go
to the smaller id. Fewer candidates than ``k`` give fewer rows; an empty table none.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage

DEGREE = 32
REVERSE = 24
BLOCK = 1024
ORDERS = 6
#: Rounds of either kind end by themselves; more than these mean that something is wrong, and raise.
MOST_ROUNDS, MOST_STEPS = 60, 200
LEAST_CHANGE = 0.02
RERANK = 64
BEAM = 192
OPEN = 96
#: Nodes of each band at which every search of it starts, besides those that stand near.
ENTRIES = 32
#: Queries that are answered exactly to measure the search, the share to be found, and how often beams are doubled for it.
SAMPLE, LEAST_RECALL, MOST_WIDENED = 64, 0.92, 3
#: What 8 bits a component may add to or take from a score, as a share of the lengths.
ROUNDING = 0.02
SALTS = 16
PLANES = 32
SEED = 7


def usable(vector: Column) -> Column:
    """No null or non-finite component, and one that is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, vec`` with unique ids and usable vectors of one length."""
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vec"))
    once = cut_lineage(rows.groupBy("id").agg(F.min("vec").alias("vec")))
    commonest = once.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return once.where(F.size("vec") == (commonest.d if commonest else 0))


def _nodes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id -> node, node -> ids): a node is the smallest id of equal vectors and lists its ``k + 1`` smallest."""
    keyed = vectors.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    groups = cut_lineage(few.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")))
    return keyed.join(groups.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"), groups.select("node", "ids")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binary values as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), width)


#: Bytes of a code beyond its components: their scale, and the length within the band.
EXTRA = 8


def _opened(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions of unit length, lengths as shares of the band's greatest) of coded vectors."""
    tail = np.ascontiguousarray(rows[:, -EXTRA:]).view("<f4")
    return rows[:, :-EXTRA].astype(np.float32) * tail[:, :1], tail[:, 1:]


def _code(vectors: DataFrame, centre: list[float]) -> DataFrame:
    """``id, band, log_length, direction`` -> ``id, band, code, o0, o1, ...``: components in 8 bits, and a sort key for each first order."""
    d = len(centre)
    planes = np.random.default_rng(SEED).normal(size=(ORDERS, PLANES, d)).astype(np.float32)
    middle = np.array(centre, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
            small = np.rint(x / np.abs(x).max(1)[:, None] * 127).astype(np.int8)
            scale = 1 / np.sqrt((small.astype(np.float64) ** 2).sum(1))
            share = np.exp2(batch.column(2).to_numpy() - batch.column(1).to_numpy() - 1)
            coded = np.hstack([small, np.stack([scale, share], 1).astype("<f4").view(np.int8)])
            signs = (x.astype(np.float32) - middle) @ planes.reshape(-1, d).T > 0
            keys = signs.reshape(len(x), ORDERS, PLANES) @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in coded], pa.binary())] + [pa.array(keys[:, o]) for o in range(ORDERS)], ["id", "band", "code"] + [f"o{o}" for o in range(ORDERS)])

    return vectors.select("id", "band", "log_length", "direction").mapInArrow(run, "id long, band int, code binary, " + ", ".join(f"o{o} long" for o in range(ORDERS)))


def _in_blocks(width: int, block: int, compare):
    """Rows ``id, band, guest, code`` -> what ``compare`` finds in blocks of consecutive rows; what is left at the end is never a short block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool), np.empty((0, width), np.int8)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)] + [_flat(batch.column(3), width)]
            held = [np.concatenate(p) for p in zip(held, new)]
            while len(held[0]) >= 2 * block:
                yield from compare(*[h[:block] for h in held])
                held = [h[block:] for h in held]
        if len(held[0]):
            yield from compare(*held)

    return run


def _first_neighbours(degree: int):
    """Each node's nearest directions of its band among the nodes of a block."""

    def compare(ids, bands, guest, rows) -> Iterator[pa.RecordBatch]:
        x = _opened(rows)[0]
        sim = x @ x.T
        sim[bands[:, None] != bands[None, :]] = -np.inf
        np.fill_diagonal(sim, -np.inf)
        most = min(degree, len(ids) - 1)
        if most > 0:
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(sim, best, 1)
            row, at = np.nonzero(value > -np.inf)
            yield pa.record_batch([pa.array(ids[row]), pa.array(ids[best[row, at]]), pa.array(value[row, at])], ["u", "v", "sim"])

    return compare


def _near_guests(degree: int):
    """Each guest's nearest nodes of its band, by inner product, in a block."""

    def compare(ids, bands, guest, rows) -> Iterator[pa.RecordBatch]:
        x, share = _opened(rows)
        nodes, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        if len(nodes) and len(guests):
            sim = x[guests] @ (x[nodes] * share[nodes]).T
            sim[bands[guests][:, None] != bands[nodes][None, :]] = -np.inf
            most = min(degree, len(nodes))
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            row, at = np.nonzero(np.take_along_axis(sim, best, 1) > -np.inf)
            yield pa.record_batch([pa.array(ids[guests][row]), pa.array(bands[guests][row]), pa.array(ids[nodes][best[row, at]])], ["q", "band", "v"])

    return compare


def _placed(rows: DataFrame, order: int, block: int, size: int) -> DataFrame:
    """``id, band, guest, code`` by band and sort key, with enough rows in each task for whole blocks."""
    keys = ["band", f"o{order}", "id"]
    return rows.select("guest", "code", *keys).repartitionByRange(min(10_000, max(1, size // (4 * block))), *keys).sortWithinPartitions(*keys).select("id", "band", "guest", "code")


def _local_joins(width: int):
    """Rows ``center, member, fresh, floor, code`` sorted by centre -> pairs of members that beat the first one's ``floor``."""

    def pairs(member, fresh, floor, rows):
        x = _opened(rows)[0]
        sim = x @ x.T
        good = (sim > floor[:, None]) & (fresh[:, None] | fresh[None, :]) & (member[:, None] != member[None, :])
        a, b = np.nonzero(good)
        return member[a], member[b], sim[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)] + [_flat(batch.column(4), width)]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            starts = np.flatnonzero(np.diff(held[0])) + 1  # the last centre may go on in the next batch
            if len(starts):
                yield from _of_centres([h[: starts[-1]] for h in held], np.concatenate(([0], starts[:-1])), pairs)
                held = [h[starts[-1] :] for h in held]
        if held is not None and len(held[0]):
            yield from _of_centres(held, np.array([0]), pairs)

    return run


def _of_centres(held: list[np.ndarray], starts: np.ndarray, pairs) -> Iterator[pa.RecordBatch]:
    found, size = [], 0
    for start, end in zip(starts, [*starts[1:], len(held[0])]):
        found.append(pairs(held[1][start:end], held[2][start:end].astype(bool), held[3][start:end], held[4][start:end]))
        size += len(found[-1][0])
        if size > 200_000:
            yield pa.record_batch([pa.array(np.concatenate(p)) for p in zip(*found)], ["u", "v", "sim"])
            found, size = [], 0
    if size:
        yield pa.record_batch([pa.array(np.concatenate(p)) for p in zip(*found)], ["u", "v", "sim"])


def _nearest(offers: DataFrame, degree: int) -> DataFrame:
    """``u, v, sim, fresh``: the ``degree`` nearest of each ``u``, each ``v`` once; fresh if never seen in an older list."""
    # one shuffle by u serves the distinct pairs and the ranking
    once = offers.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", place).where(F.col("r") <= degree).drop("r")


def neighbour_graph(codes: DataFrame, width: int, degree: int = DEGREE, reverse: int = REVERSE, block: int = BLOCK, rounds: int | None = None) -> DataFrame:
    """``u, v, sim, fresh``: about the ``degree`` nodes of every node's band that are nearest in direction, by NN-descent until it converges (or for ``rounds``)."""
    offers, nodes = None, codes.withColumn("guest", F.lit(False))
    number = codes.count()
    for o in range(ORDERS):
        found = _placed(nodes, o, block, number).mapInArrow(_in_blocks(width, block, _first_neighbours(degree)), "u long, v long, sim float")
        offers = found if offers is None else offers.unionByName(found)
    graph = cut_lineage(_nearest(offers.withColumn("fresh", F.lit(1)), degree))
    size = graph.count()
    for step in range(MOST_ROUNDS if rounds is None else rounds):
        priority = F.xxhash64("u", "v", F.lit(step))
        back = graph.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), priority)).alias("r")).where(F.col("r") <= reverse).drop("r")
        members = graph.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh").unionByName(back)
        floors = graph.groupBy("u").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).select(F.col("u").alias("member"), F.when(F.col("n") >= degree, F.col("floor")).otherwise(float("-inf")).cast("float").alias("floor"))
        held = codes.select(F.col("id").alias("member"), "code").join(floors, "member")
        gathered = members.join(held, "member").select("center", "member", "fresh", "floor", "code")
        offered = gathered.repartition("center").sortWithinPartitions("center").mapInArrow(_local_joins(width), "u long, v long, sim float")
        graph = cut_lineage(_nearest(graph.withColumn("fresh", F.lit(0)).unionByName(offered.withColumn("fresh", F.lit(1))), degree))
        if graph.where("fresh = 1").count() <= LEAST_CHANGE * size:
            break
    else:
        if rounds is None:
            raise RuntimeError("the graph has not settled")
    return graph


def _scores(width: int):
    """Rows ``q, band, v, qcode, code`` -> inner products, as shares of the query's length and the band's greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, (b, share) = _opened(_flat(batch.column(3), width))[0], _opened(_flat(batch.column(4), width))
            sim = np.einsum("ij,ij->i", a, b) * share[:, 0]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(sim.astype(np.float32))], ["q", "band", "v", "sim"])

    return run


class Search:
    """Greedy searches of all queries (q, band, code) in bands of a graph, step by step together."""

    def __init__(self, graph: DataFrame, codes: DataFrame, asked: DataFrame, width: int, reverse: int = REVERSE) -> None:
        near = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), near.alias("r")).where(F.col("r") <= reverse).drop("r")
        self.roads = cut_lineage(graph.select("u", "v").unionByName(back).distinct())
        self.codes, self.asked, self.width = codes, asked, width
        self.coded = codes.select(F.col("id").alias("v"), "code")
        self.asking = asked.select("q", F.col("code").alias("qcode"))

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.coded, "v").join(self.asking, "q").select("q", "band", "v", "qcode", "code").mapInArrow(_scores(self.width), "q long, band int, v long, sim float")

    def own_starts(self) -> DataFrame:
        """``q, band, v, sim, opened``: each query's node and that node's neighbours."""
        own = self.asked.select("q", "band", F.col("q").alias("v"))
        beside = self.roads.withColumnRenamed("u", "q").join(self.asked.select("q", "band"), "q").select("q", "band", "v")
        return cut_lineage(self.score(own.unionByName(beside).distinct()).withColumn("opened", F.col("q") == F.col("v")))

    def guest_starts(self, own: DataFrame, k: int, degree: int, block: int) -> DataFrame | None:
        """Starts in the other bands that may hold one of a query's ``k`` nearest; None if there are none."""
        bands = sorted(r.band for r in self.codes.select("band").distinct().collect())  # no more than a double has exponents
        if len(bands) < 2:
            return None
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "v"))
        floor = own.where(F.col("q") != F.col("v")).withColumn("r", rank).where(F.col("r") == k).select("q", F.col("sim").alias("floor"))
        wanted = self.asked.join(floor, "q", "left").select("q", F.col("band").alias("home"), "floor", F.explode(F.array(*map(F.lit, bands))).alias("band"))
        # in shares of a band's greatest length: floor * 2^home <= 2^band, with what rounding may change
        reaches = F.col("floor").isNull() | (F.col("floor") <= ROUNDING) | (F.log2(F.col("floor") - ROUNDING) <= F.col("band") - F.col("home"))
        wanted = cut_lineage(wanted.where((F.col("band") != F.col("home")) & reaches).select("q", "band"))
        many = wanted.count()
        if not many:
            return None
        keys = self.codes.select(F.col("id").alias("q"), *[f"o{o}" for o in range(ORDERS)])
        guests = wanted.join(keys, "q").join(self.asking, "q").select(F.col("q").alias("id"), "band", F.lit(True).alias("guest"), F.col("qcode").alias("code"), *[f"o{o}" for o in range(ORDERS)])
        rows = cut_lineage(self.codes.withColumn("guest", F.lit(False)).unionByName(guests))
        fixed = self.codes.select("band", F.col("id").alias("v"), F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("id"), "id")).alias("r")).where(F.col("r") <= ENTRIES).drop("r")
        found = wanted.join(F.broadcast(fixed), "band").select("q", "band", "v")  # as many rows as there are bands, times ENTRIES
        size = rows.count()
        for o in range(ORDERS):
            found = found.unionByName(_placed(rows, o, block, size).mapInArrow(_in_blocks(self.width, block, _near_guests(degree)), "q long, band int, v long"))
        return self.score(found.distinct()).withColumn("opened", F.lit(False))

    def go_on(self, state: DataFrame, beam: int, open_at_once: int = OPEN) -> DataFrame:
        """``state`` when all of the ``beam`` nearest of each query and band have been opened."""
        best = Window.partitionBy("q", "band").orderBy(F.desc("sim"), "v")
        waiting = Window.partitionBy("q", "band", "opened").orderBy(F.desc("sim"), "v")
        for _ in range(MOST_STEPS):
            marked = state.withColumn("now", ~F.col("opened") & (F.row_number().over(waiting) <= open_at_once))
            reached = marked.where("now").join(self.roads.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("q", "band", F.col("w").alias("v")).distinct()
            fresh = self.score(reached.join(state.select("q", "band", "v"), ["q", "band", "v"], "left_anti")).withColumn("opened", F.lit(False))
            every = marked.select("q", "band", "v", "sim", (F.col("opened") | F.col("now")).alias("opened")).unionByName(fresh)
            state = cut_lineage(every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"))
            if not state.where("NOT opened").limit(1).count():
                return state
        raise RuntimeError("the search has not ended")


def _exact(ids: np.ndarray, matrix: np.ndarray, k: int):
    """Rows ``id, vec`` -> of each batch the ``k`` nearest to each of a few bounded vectors, other than itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), matrix.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                sim = np.nan_to_num(x @ matrix.T, nan=-np.inf)
            sim[own[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own[:, None], sim.shape), -sim), axis=0)[:k]
            yield pa.record_batch([pa.array(np.tile(ids, len(order))), pa.array(own[order].ravel()), pa.array(np.take_along_axis(sim, order, 0).ravel())], ["q", "v", "score"])

    return run


def nearest(table: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, block: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of every row that meets ``query`` (a condition on ``id``)."""
    vectors = _vectors(table, vec_id, vector)
    belongs, members = _nodes(vectors, k)
    belongs = cut_lineage(belongs)
    first = vectors.select(F.size("vec").alias("d")).first()
    if first is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = first.d
    # without squares that overflow: relative to the largest component
    most = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    own = vectors.join(members.select(F.col("node").alias("id")), "id", "left_semi").withColumn("most", most).withColumn("part", F.transform("vec", lambda x: x / F.col("most")))
    own = own.withColumn("size", F.sqrt(F.aggregate("part", F.lit(0.0), lambda a, x: a + x * x))).withColumn("log_length", F.log2("most") + F.log2("size"))
    own = cut_lineage(own.select("id", "vec", "log_length", F.floor("log_length").cast("int").alias("band"), F.transform("part", lambda x: x / F.col("size")).alias("direction")))
    centre = own.agg(*[F.avg(F.col("direction")[i]) for i in range(d)]).first()
    width = d + EXTRA
    codes = cut_lineage(_code(own, list(centre)))
    asking = cut_lineage(belongs.where(query))
    asked = cut_lineage(codes.join(asking.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q"), "band", "code"))
    search = Search(neighbour_graph(codes, width, degree, block=block), codes, asked, width)
    state = search.own_starts()
    guests = search.guest_starts(state, k, degree, block)
    state = search.go_on(state if guests is None else cut_lineage(state.unionByName(guests)), beam)
    exact = own.select(F.col("id").alias("v"), F.col("vec").alias("vvec"))
    dot = F.aggregate(F.zip_with("qvec", "vvec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

    def scored() -> DataFrame:
        near = state.withColumn("r", F.row_number().over(Window.partitionBy("q", "band").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= RERANK).select("q", "v")
        return cut_lineage(near.join(exact, "v").join(own.select(F.col("id").alias("q"), F.col("vec").alias("qvec")), "q").select("q", "v", dot.alias("score")))

    found = scored()
    sample = asked.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).select(F.col("q").alias("id")).join(own, "id").select("id", "vec").collect()
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    if sample:
        ids, matrix = np.array([r.id for r in sample], np.int64), np.array([r.vec for r in sample], float)
        want = own.select("id", "vec").mapInArrow(_exact(ids, matrix, k), "q long, v long, score double")
        want = cut_lineage(want.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).select("q", "v"))
        many = want.count()
        for _ in range(MOST_WIDENED):
            got = found.where(F.col("q").isin(ids.tolist()) & (F.col("q") != F.col("v"))).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).join(want, ["q", "v"], "left_semi").count()
            if got >= LEAST_RECALL * many:
                break
            beam *= 2
            state = search.go_on(state, beam)
            found = scored()
    # k + 1 ids per query node are enough: a query takes no place in its own list
    listed = found.join(members.withColumnRenamed("node", "v"), "v").select("q", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = cut_lineage(listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")))
    answered = asking.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(lists, "q")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    rows = answered.select("query_id", F.posexplode(others).alias("at", "f"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
