"""Near-duplicate vectors by a robust-pruned flat graph that is built and searched in overlapping shards.

1. Equal vectors form a class; what follows works on classes. Centres come from spherical k-means on a bounded
   sample (`SAMPLE` classes); every class goes to its `OVERLAP` nearest centres. A centre with more than
   `SHARD_ROWS` members is cut into shards by a hash of the id, and its members visit all of them.
2. A shard builds a flat graph: each member's nearest members, robust-pruned (a neighbour is dropped if a nearer
   one covers it), with the reverse edges. Each member and visitor then searches from the shard's medoid:
   greedily with a beam, then range-expanding, which follows the neighbours of everything found within the
   range until nothing is added.
3. The adjacency lists of all shards are united; edges that can lie within one range (cosine 0.62 and more for a range
   of 0.9) expand what was found in one shard into the others, again until nothing is added.
4. Every link is verified by the cosine in double precision of the vectors as given.

`audit_recall` compares links with brute force for the rows whose id is divisible by 100.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; rows that share an id give one row with the links of all of them
added up; rows without an id are left out. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, query, quoted, table
from tablewright.llm.graph import components

LEAST = 0.9
SAMPLE = 20_000
MOST_CENTRES = 4096
CLASSES_PER_CENTRE = 600
OVERLAP = 3
SHARD_ROWS = 3000
NEAREST, DEGREE, ALPHA = 48, 16, 1.2
BEAM = 32
BLOCK = 512

FOUND = "kind int, a long, b long"
LINK, EDGE = 0, 1


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def centres(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; centres that lose all members keep their place."""
    rng = np.random.default_rng(11)
    middle = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ middle.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(size > 0, sums / np.where(size > 0, size, 1), middle)
    return middle


def flat_graph(rows: np.ndarray) -> np.ndarray:
    """Neighbours [node, place] of each node (-1: none): robust-pruned lists with the reverse edges."""
    count, near = len(rows), min(NEAREST, len(rows) - 1)
    out = np.full((count, 3 * DEGREE), -1, np.int32)
    if near < 1:
        return out
    kept: list[np.ndarray] = []
    for a in range(0, count, BLOCK):
        close = rows[a : a + BLOCK] @ rows.T
        close[np.arange(len(close)), np.arange(a, a + len(close))] = -2
        ids = np.argpartition(-close, near - 1, axis=1)[:, :near]
        ids = np.take_along_axis(ids, np.argsort(-np.take_along_axis(close, ids, 1), axis=1, kind="stable"), 1)
        far = 2 - 2 * np.take_along_axis(close, ids, 1)
        for lo in range(0, len(ids), 128):
            some, away = ids[lo : lo + 128], far[lo : lo + 128]
            between = 2 - 2 * np.einsum("bid,bjd->bij", rows[some], rows[some])
            alive = np.ones(some.shape, bool)
            chosen = np.zeros(some.shape, bool)
            line = np.arange(len(some))
            for _ in range(DEGREE):
                has = alive.any(axis=1)
                if not has.any():
                    break
                first = alive.argmax(axis=1)
                chosen[line[has], first[has]] = True
                alive &= ~((ALPHA**2 * between[line, first] <= away) & has[:, None])
                alive[line[has], first[has]] = False
            node, place = np.nonzero(chosen)
            kept.append(np.stack((node + a + lo, some[node, place])))
    edges = np.concatenate(kept, axis=1)
    edges = np.unique(np.concatenate((edges, edges[::-1]), axis=1), axis=1)
    near_first = np.lexsort((-np.einsum("ed,ed->e", rows[edges[0]], rows[edges[1]]), edges[0]))
    edges = edges[:, near_first]
    place = np.arange(edges.shape[1]) - np.searchsorted(edges[0], edges[0])
    fits = place < out.shape[1]
    out[edges[0][fits], place[fits]] = edges[1][fits]
    return out


def range_search(rows: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """Mask [query, node] of the nodes found within the range."""
    count, asked = len(rows), np.arange(len(queries))
    start = int((rows @ rows.mean(axis=0)).argmax())  # the medoid
    seen, hits, spent = (np.zeros((len(queries), count), bool) for _ in range(3))
    beam = np.full((len(queries), 1), start)
    score = queries @ rows[start][:, None]
    seen[:, start] = True
    hits[:, start] = score[:, 0] >= least
    done = np.zeros(beam.shape, bool)
    while True:
        waiting = np.where(done, -np.inf, score)
        best = waiting.argmax(axis=1)
        go = np.flatnonzero(np.isfinite(waiting[asked, best]))
        if not len(go):
            break
        done[go, best[go]] = True
        node = beam[go, best[go]]
        spent[go, node] = True
        next_ids = graph[node]
        fresh = (next_ids >= 0) & ~seen[go[:, None], next_ids]
        value = np.where(fresh, np.einsum("qd,qnd->qn", queries[go], rows[next_ids]), -np.inf)
        at, place = np.nonzero(fresh)
        seen[go[at], next_ids[at, place]] = True
        hits[go[at], next_ids[at, place]] = value[at, place] >= least
        grown = np.full((len(queries), next_ids.shape[1]), -np.inf)
        grown[go] = value
        new_ids = np.zeros(grown.shape, beam.dtype)
        new_ids[go] = next_ids
        beam, score = np.concatenate((beam, new_ids), axis=1), np.concatenate((score, grown), axis=1)
        done = np.concatenate((done, ~np.isfinite(grown)), axis=1)
        if beam.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            beam, score, done = (np.take_along_axis(x, top, 1) for x in (beam, score, done))
    while True:  # the range itself, however many it holds
        who, node = np.nonzero(hits & ~spent)
        if not len(who):
            return hits
        spent[who, node] = True
        for a in range(0, len(who), 4096):
            q, next_ids = np.repeat(who[a : a + 4096], graph.shape[1]), graph[node[a : a + 4096]].ravel()
            some = (next_ids >= 0) & ~seen[q, next_ids]
            q, next_ids = q[some], next_ids[some]
            seen[q, next_ids] = True
            hits[q, next_ids] |= np.einsum("ed,ed->e", queries[q], rows[next_ids]) >= least


def search_shards(placed: DataFrame, partitions: int, least: float) -> DataFrame:
    """Links found and edges kept (kind, a, b) from rows (centre, shard, visits, id, vector)."""
    slack = 1e-9  # what the search leaves out is far below the range; the last word has the double cosine
    edge = 2 * least * least - 1 - 1e-6

    def searched(batches):
        held: list[pa.RecordBatch] = []

        def solve():
            group = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            visits = group.column("visits").to_numpy()
            ids, rows = group.column("id").to_numpy(), unit(matrix(group.column("vector").combine_chunks()))
            own = np.flatnonzero(~visits.astype(bool))
            if not len(own):
                return
            members, names = rows[own], ids[own]
            graph = flat_graph(members)
            node, place = np.nonzero(graph >= 0)
            other = graph[node, place]
            strong = np.einsum("ed,ed->e", members[node], members[other]) >= edge
            yield records(EDGE, names[node[strong]], names[other[strong]])
            for a in range(0, len(rows), BLOCK):
                who, found = np.nonzero(range_search(members, graph, rows[a : a + BLOCK], least - slack))
                left, right = ids[a + who], names[found]
                yield records(LINK, left[left != right], right[left != right])

        last = None
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in (0, 1)]
            change = np.flatnonzero((marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                group = (int(marks[0][lo]), int(marks[1][lo]))
                if group != last and held:
                    yield from solve()
                last = group
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve()

    ordered = placed.select("centre", "shard", "visits", "id", "vector")
    return ordered.repartition(partitions, "centre", "shard").sortWithinPartitions("centre", "shard", "visits", "id").mapInArrow(
        searched, FOUND
    )


def records(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"]
    )


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a < b) whose cosine in double precision reaches `least`."""
    left = classes.select(F.col("id").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    dot = "aggregate(zip_with(x, y, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    size = "sqrt(aggregate(x, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0D, (s, v) -> s + v * v))"
    return pairs.join(left, "a").join(right, "b").where(f"{dot} / ({size}) >= {least!r}").select("a", "b")


def linked_classes(classes: DataFrame, least: float, scratch: Scratch, partitions: int) -> DataFrame:
    """a, b: links between classes (id, vector) of one vector length, a < b."""
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    middle = centres(unit(matrix(sample)), int(np.clip(-(-count // CLASSES_PER_CENTRE), 1, MOST_CENTRES)))
    overlap = min(OVERLAP, len(middle))

    def assigned(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                near = np.argsort(-(unit(matrix(part.column(1))) @ middle.T), axis=1, kind="stable")[:, :overlap]
                row = pa.array(np.repeat(np.arange(part.num_rows), overlap))
                yield pa.record_batch(
                    [pa.array(near.ravel().astype(np.int32)), part.column(0).take(row), part.column(1).take(row)],
                    names=["centre", "id", "vector"],
                )

    placed = classes.select("id", "vector").mapInArrow(assigned, "centre int, id long, vector array<double>")
    placed = scratch.write(placed, "assigned")
    sizes = scratch.write(placed.groupBy("centre").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")), "sizes")
    placed = placed.join(F.broadcast(sizes), "centre")  # one small row per centre, MOST_CENTRES at most
    placed = placed.withColumn("home", F.expr("cast(pmod(xxhash64(id), shards) AS int)"))
    placed = placed.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).withColumn("visits", F.expr("cast(shard <> home AS int)"))
    found = scratch.write(search_shards(placed, partitions, least), "found")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links = found.where(f"kind = {LINK}").select(*pair).distinct()
    links = scratch.write(verified(links, classes, least), "links")
    edges = scratch.write(found.where(f"kind = {EDGE}").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "edges")
    fresh = links
    while True:  # neighbours, in any shard, of what lies within the range
        both = fresh.select("a", "b").union(fresh.select(F.col("b"), F.col("a")))
        near = both.join(edges, both["b"] == edges["x"]).where("a <> y").select(
            F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")
        ).distinct()
        fresh = scratch.write(verified(near.join(links, ["a", "b"], "left_anti"), classes, least), "more")
        if not fresh.limit(1).count():
            return links
        links = scratch.write(links.union(fresh), "links")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """id, n_links, component_id, kept: one row per id."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    fit = (
        "coalesce(size(vector) > 0 AND forall(vector, v -> coalesce(abs(v) < double('infinity') AND NOT isnan(v), false)) "
        "AND exists(vector, v -> v <> 0), false)"
    )
    with Scratch(spark, "vectors") as scratch:
        usable = rows.where(fit)
        classes = scratch.write(
            usable.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "vector", "copies"), "classes"
        )
        lengths = sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect())
        found = [
            linked_classes(classes.where(F.size("vector") == n).select("id", "vector"), least, scratch, partitions) for n in lengths
        ]
        links = spark.createDataFrame([], "a long, b long")
        for part in found:
            links = links.unionByName(part)
        links = scratch.write(links, "all")
        parts = components(links, scratch)
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        counts = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
        known = classes.join(counts, classes["id"] == counts["a"], "left").join(parts, classes["id"] == parts["node"], "left").select(
            "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        known = scratch.write(known, "known")
        out = usable.join(known, "vector").select("id", "n_links", "component_id")
        out = out.unionByName(rows.where(f"NOT {fit}").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
        out = out.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        return scratch.keep(out.withColumn("kept", F.col("id") == F.col("component_id")))


def audit_recall(df: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> float:
    """Share of the links of all rows whose id is divisible by 100 that `result` counts, by brute force in blocks."""
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND size(vector) > 0 AND exists(vector, v -> v <> 0) AND forall(vector, v -> coalesce(abs(v) < double('infinity'), false))")
    asked, true, got = rows.where("id % 100 = 0"), 0, 0
    block: list = []

    def count(block: list) -> tuple[int, int]:
        names, vectors = np.array([r[0] for r in block]), [np.array(r[1]) for r in block]

        def brute(batches):
            for batch in batches:
                total = np.zeros(len(vectors), np.int64)
                ids = batch.column(0).to_numpy()
                lists = batch.column(1).to_pylist()
                for k, v in enumerate(vectors):
                    fit = [i for i, x in enumerate(lists) if len(x) == len(v) and ids[i] != names[k]]
                    if fit:
                        m = np.array([lists[i] for i in fit])
                        total[k] = ((m @ v) / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)) >= least).sum()
                yield pa.record_batch([pa.array(names), pa.array(total)], names=["id", "n"])

        exact = rows.mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        both = exact.join(result.select("id", "n_links"), "id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        return both[0] or 0, both[1] or 0

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            more, have = count(block)
            true, got, block = true + more, got + have, []
    if block:
        more, have = count(block)
        true, got = true + more, got + have
    return got / true if true else 1.0


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")
