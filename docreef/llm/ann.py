"""Nearest neighbours by largest inner product: a navigable small-world graph a shard, shard results merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreef.llm.common import arrow_schema, written

#: Vectors of a shard, at about which a graph of plain arrays is still built in a task's time and memory.
SHARD = 1 << 14
#: Queries of a block, which goes to every shard as one row, and blocks that a task takes past one shard.
BLOCK, BLOCKS = 2048, 64


def unit(x: np.ndarray) -> np.ndarray:
    """x times the power of two that brings its largest component to [0.5, 1): the same order in 32 bits, at any size."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0.0))[1]))


class Graph:
    """A hierarchical navigable small-world graph (Malkov and Yashunin 2016) in flat arrays.

    Points get one more coordinate that makes all of them equally long, so that the largest inner product is the
    nearest point; a query's is 0. ``links[0]`` is (n, 2 * degree) neighbours, -1 where there are fewer; a higher
    level has its points in ``points[level]``, ascending, and a row of neighbours for each.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, breadth: int = 96, seed: int = 5):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.degree, self.breadth, self.seed = degree, breadth, seed
        scaled = unit(self.vectors)
        squares = (scaled**2).sum(1)
        rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
        self.lifted = np.hstack([scaled, rest[:, None]]).astype(np.float32)
        self.stamp = np.zeros(len(vectors), np.int64)
        self.token = 0

    def _search(self, q: np.ndarray, entries: list[tuple[float, int]], breadth: int, links) -> list[tuple[float, int]]:
        """The best ``breadth`` points found from the entries, best first. links: neighbours of a point."""
        self.token += 1
        token, stamp, lifted = self.token, self.stamp, self.lifted
        best = list(entries)
        heapq.heapify(best)
        todo = [(-s, x) for s, x in entries]
        heapq.heapify(todo)
        stamp[[x for _, x in entries]] = token
        while todo:
            s, x = heapq.heappop(todo)
            if len(best) >= breadth and -s < best[0][0]:
                break
            near = links(x)
            near = near[stamp[near] != token]
            if not len(near):
                continue
            stamp[near] = token
            sims = lifted[near] @ q
            if len(best) >= breadth:
                on = sims > best[0][0]
                near, sims = near[on], sims[on]
            for s2, y in zip(sims.tolist(), near.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (s2, y))
                    heapq.heappush(todo, (-s2, y))
                elif s2 > best[0][0]:
                    heapq.heapreplace(best, (s2, y))
                    heapq.heappush(todo, (-s2, y))
        return sorted(best, reverse=True)

    def _spread(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours, best first, those nearer to the point than to one taken before; filled up with the others."""
        if len(near) <= most:
            return near
        rows = self.lifted[near]
        among = rows @ rows.T
        taken = np.zeros(len(near), bool)
        closest = np.full(len(near), -np.inf, np.float32)
        left = most
        for i in range(len(near)):
            if sims[i] > closest[i]:
                taken[i] = True
                left -= 1
                if not left:
                    break
                np.maximum(closest, among[i], out=closest)
        if left:
            taken[np.flatnonzero(~taken)[:left]] = True
        return near[taken]

    def build(self) -> Graph:
        n, lifted = len(self.vectors), self.lifted
        rng = np.random.default_rng(self.seed)
        levels = (-np.log(1 - rng.random(n)) / np.log(self.degree)).astype(int)
        top = int(levels.max(initial=0))
        room = [3 * self.degree] + [self.degree + self.degree // 2] * top  # slack: lists are thinned when it is full
        keep = [2 * self.degree] + [self.degree] * top
        rows = [np.arange(n)] + [np.full(n, -1) for _ in range(top)]
        points = [np.arange(n)]
        for level in range(1, top + 1):
            points.append(np.flatnonzero(levels >= level))
            rows[level][points[level]] = np.arange(len(points[level]))
        links = [np.full((len(p), r), -1, np.int32) for p, r in zip(points, room)]
        counts = [np.zeros(len(p), np.int32) for p in points]

        def of(level):
            own, count, row = links[level], counts[level], rows[level]
            return (lambda x: own[x, : count[x]]) if level == 0 else (lambda x: own[row[x], : count[row[x]]])

        get = [of(level) for level in range(top + 1)]
        entry, entry_level = 0, int(levels[0]) if n else 0
        for x in range(1, n):
            q, level = lifted[x], int(levels[x])
            found = [(float(lifted[entry] @ q), entry)]
            for k in range(entry_level, level, -1):
                found = self._search(q, found[:1], 1, get[k])
            for k in range(min(level, entry_level), -1, -1):
                found = self._search(q, found, self.breadth, get[k])
                near = np.array([y for _, y in found], np.int64)
                sims = np.array([s for s, _ in found], np.float32)
                chosen = self._spread(near, sims, self.degree)
                row = rows[k]
                links[k][row[x], : len(chosen)] = chosen
                counts[k][row[x]] = len(chosen)
                for y in chosen.tolist():
                    r, c = row[y], counts[k][row[y]]
                    if c < room[k]:
                        links[k][r, c] = x
                        counts[k][r] = c + 1
                        continue
                    own = np.append(links[k][r], x)
                    s = lifted[own] @ lifted[y]
                    order = np.argsort(-s, kind="stable")
                    thinned = self._spread(own[order], s[order], keep[k])
                    links[k][r, : len(thinned)] = thinned
                    links[k][r, len(thinned) :] = -1
                    counts[k][r] = len(thinned)
            if level > entry_level:
                entry, entry_level = x, level
        self.points, self.links, self.entry = points, links, entry
        return self

    def dump(self) -> dict:
        return {
            "n": len(self.vectors), "dim": self.vectors.shape[1], "entry": self.entry, "vectors": self.vectors.tobytes(),
            "points": [p.astype(np.int32).tobytes() for p in self.points], "links": [x.tobytes() for x in self.links],
        }

    @classmethod
    def load(cls, d: dict) -> Graph:
        g = cls(np.frombuffer(d["vectors"]).reshape(d["n"], d["dim"]))
        g.points = [np.frombuffer(p, np.int32) for p in d["points"]]
        g.links = [np.frombuffer(x, np.int32).reshape(len(p), -1) for x, p in zip(d["links"], g.points, strict=True)]
        g.sizes = [(x >= 0).sum(1) for x in g.links]
        g.entry = d["entry"]
        return g

    def near(self, vector: np.ndarray, breadth: int) -> np.ndarray:
        """About ``breadth`` points of largest inner product with the vector, in no order."""
        q = np.append(unit(vector), 0).astype(np.float32)
        found = [(float(self.lifted[self.entry] @ q), int(self.entry))]
        for level in range(len(self.links) - 1, 0, -1):
            row, own, size = self.points[level], self.links[level], self.sizes[level]
            found = self._search(q, found[:1], 1, lambda x: own[(r := np.searchsorted(row, x)), : size[r]])
        own, size = self.links[0], self.sizes[0]
        return np.array([x for _, x in self._search(q, found, breadth, lambda x: own[x, : size[x]])])


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def band(vector: str) -> Column:
    """The power of ten nearest to a vector's norm. Vectors of a band are alike enough in norm for sums of 32 bits."""
    v = F.col(vector)
    most = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(F.transform(v, lambda x: (x / most) * (x / most)), F.lit(0.0), lambda a, x: a + x)
    return F.round(F.log10(most) + F.log10(squares) / 2).cast("long")


_INDEX = "dim int, shard long, n long, entry long, vectors binary, points array<binary>, links array<binary>, members array<array<bigint>>"


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD, degree: int = 16, breadth: int = 96) -> DataFrame:
    """A row a shard, from rows (vec_id, vector). A shard has vectors of one dimension and of one band of norms.

    Equal vectors are one point that keeps its k + 1 smallest ids: no query can use more of them, whichever row it is
    itself. They are picked before the shuffle, so a vector that a third of all rows share stays small.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    points = (
        vectors.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    )
    points = written(points.withColumn("dim", F.size("vector")).withColumn("band", band("vector")), "ann-points")
    dims = points.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    shards = dims.agg(F.sum("shards")).first()[0] or 0
    within = F.pmod(F.xxhash64(F.col("members")[0]), F.col("shards"))
    placed = points.join(dims, ["dim", "band"]).withColumn("shard", F.col("band") * 2**32 + within).drop("band")
    placed = placed.repartition(int(min(max(3 * shards, 1), 20_000)), "dim", "shard")  # a number: else small shards share a task

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("members", key=lambda s: s.str[0], ignore_index=True)
        d = Graph(np.stack(pdf["vector"].to_numpy()), degree, breadth).build().dump()
        return pd.DataFrame([{
            "dim": d["dim"], "shard": pdf["shard"].iloc[0], "n": d["n"], "entry": d["entry"], "vectors": d["vectors"],
            "points": d["points"], "links": d["links"], "members": [list(m) for m in pdf["members"]],
        }])

    return written(placed.groupBy("dim", "shard").applyInPandas(build, _INDEX), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, breadth: int = 160, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, vector) as queries, a query's own row left out.

    A task has one shard and up to ``blocks`` blocks of queries of its dimension: it loads the shard's graph, which comes
    first, once, and takes the blocks past it one by one, so its memory is a graph and a block. Each gives a query's k
    best of the shard. Queries with one id and different vectors are ranked apart.
    """
    n = queries.count()
    groups, every = max(1, -(-n // (block * blocks))), max(1, -(-n // block))
    shard_bits = F.lit(2**32)
    spans = index.groupBy("dim", F.floor(F.col("shard") / shard_bits).alias("band")).agg((F.max(F.pmod("shard", shard_bits)) + 1).alias("n"), F.count(F.lit(1)).alias("shards"))
    spans = written(spans, "ann-spans")  # a row a dimension and band
    units = (spans.agg(F.sum("shards")).first()[0] or 0) * groups
    spans = spans.agg(F.collect_list(F.struct("dim", "band", "n")).alias("spans"))
    which = F.row_number().over(Window.partitionBy("vec_id").orderBy("vector"))
    asked = queries.withColumn("dim", F.size("vector")).withColumn("which", which)
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(every)).alias("block")).agg(F.collect_list(F.struct("vec_id", "which", "vector")).alias("queries"))
    own = F.transform(F.filter("spans", lambda x: x["dim"] == F.col("dim")), lambda x: F.sequence((x["band"] * 2**32).cast("long"), (x["band"] * 2**32 + x["n"] - 1).cast("long")))
    sent = packed.crossJoin(F.broadcast(spans)).select("dim", F.explode(F.flatten(own)).alias("shard"), F.pmod("block", F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), "queries")
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("kind"), "n", "entry", "vectors", "points", "links", "members")
    both = held.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(int(min(max(3 * units, 1), 20_000)), "dim", "shard", "grp").sortWithinPartitions("dim", "shard", "grp", "kind")
    schema = arrow_schema("query_id long, which int, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, graph, members = None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(i)[at] for i, c in enumerate(batch.schema.names)}
                unit = tuple(row[c].as_py() for c in ("dim", "shard", "grp"))
                if row["kind"].as_py() == 0:
                    graph = Graph.load({c: row[c].as_py() for c in ("n", "dim", "entry", "vectors", "points", "links")})
                    loaded, members = unit, row["members"].as_py()
                    continue
                if loaded != unit:  # a number within the span that no vector fell on
                    continue
                asked = row["queries"].values
                ids, sorts = asked.field("vec_id").to_pylist(), asked.field("which").to_pylist()
                vectors = asked.field("vector").flatten().to_numpy().reshape(len(ids), unit[0])
                out = []
                for own, which, vector in zip(ids, sorts, vectors, strict=True):
                    near = graph.near(vector, max(breadth, k + 1))
                    scores = (graph.vectors[near] * vector).sum(1)  # row by row: equal vectors score alike
                    same = (graph.vectors[near] == vector).all(1)
                    hits = sorted((-s, int(m)) for s, x, e in zip(scores.tolist(), near.tolist(), same.tolist()) for m in members[x] if m != own or not e)
                    out += [(own, which, m, -s) for s, m in hits[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    hits = dealt.mapInArrow(run, "query_id long, which int, vec_id long, score double")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """Each query's k nearest of all other rows; queries are the rows whose id is divisible by ``every``.

    Edge cases: rows without an id, and vectors that are null, empty or zero or hold null or non-finite components, take
    no part; rows with one id and different vectors are rows of their own, as queries and as candidates, while
    repeated rows of one id and vector count once; vectors of another dimension than the query's are no
    candidates; equal scores go by id; with fewer candidates than k there are fewer rows; no rows give no rows; other
    columns are not read.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vector"))
    rows = written(rows.distinct(), "ann-rows")
    build = {x: options.pop(x) for x in ("shard_rows", "degree") if x in options}
    return search(build_index(rows, k, **build), rows.where(F.col("vec_id") % every == 0), k, **options)
