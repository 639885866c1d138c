"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Equal vectors are one node, which keeps its smallest ids. The graph starts from hashed neighbours. An iteration
gathers, at each node, its neighbours and a bounded number of the nodes that name it, compares them with each other (a local
join of neighbours of neighbours) where at least one is new, and sends each member the better ones of its company; a node keeps the best
``K``. For the descent vectors are unit vectors of 16-bit floats.

The descent ends once fewer than ``STILL`` neighbours a node are replaced in an iteration; a search ends when its beam is visited.
A query is a node of the graph: its search starts from its own neighbours, and each step joins the unvisited best of each query's
``BEAM`` candidates with the graph, whose rows carry the neighbours' vectors, so that only candidates that can enter the beam are
returned. The best nodes of a query are scored again on the original vectors in double precision, and equal vectors are
expanded into ids.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not
the commonest one (the smaller of two); a null vec_id takes no part; rows with one vec_id are one candidate each; fewer than
five other vectors: all of them are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayline.llm import common

K, REVERSE = 32, 24
#: Better companions that a member hears of from one local join, at most.
NEWS = 6
#: Share of nodes under which the number of replaced neighbours ends the descent.
STILL = 0.5
BEAM = 160
NEAREST = 5
#: A node with more than one in this many of all queries is dealt in parts.
PARTS = 500


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles), of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(whole & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (width["n"] if width else 0))


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, v, u: 16-bit unit vector) and their members (node, vec_id, place), the NEAREST + 1 smallest of each."""
    keyed = rows.select(F.md5(F.to_json("v")).alias("key"), "vec_id", "v")
    ranked = keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= NEAREST + 1)
    few = common.saved(ranked, "nn-members")

    def shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, 1))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
            yield pd.DataFrame({"node": b["vec_id"], "v": b["v"], "u": [r.tobytes() for r in x]})

    heads = few.where("place = 1").select("key", F.col("vec_id").alias("node"), "v")
    nodes = common.saved(heads.select(F.col("node").alias("vec_id"), "v").mapInPandas(shortened, "node long, v array<double>, u binary"), "nn-nodes")
    members = few.join(heads.select("key", "node"), "key").select("node", "vec_id", "place")
    return nodes, members


def started(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (node, near, sim, fresh) to hashed partners: nodes are numbered by hash, and each takes some others at hashed distances."""
    order = nodes.select("node").repartitionByRange(F.xxhash64("node")).sortWithinPartitions(F.xxhash64("node"))
    numbered = common.saved(order.select("node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "nn-order")
    sizes = sorted((r["part"], r["low"], r["n"]) for r in numbered.groupBy("part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")).collect())
    total, shift = 0, {}
    for part, low, count in sizes:
        shift[part] = total - low
        total += count
    moved = F.col("at") + F.element_at(F.create_map(*(F.lit(x) for kv in shift.items() for x in kv)), F.col("part")) if shift else F.col("at")
    placed = common.saved(numbered.select("node", moved.alias("at")), "nn-places")
    tries = F.array(*(F.pmod(F.col("at") + F.pmod(F.xxhash64("node", F.lit(t)), F.lit(max(n - 1, 1))) + 1, F.lit(max(n, 1))) for t in range(K)))
    picks = placed.select("node", F.explode(F.array_distinct(tries)).alias("at"))
    return picks.join(placed.select("at", F.col("node").alias("near")), "at").where("node != near").select("node", "near", F.lit(-2.0).cast("float").alias("sim"), F.lit(True).alias("fresh"))


EDGE = "node long, near long, sim float"


def local_join(edges: DataFrame, nodes: DataFrame, start: bool) -> DataFrame:
    """Better neighbours (node, near, sim) found among the company of each node; at the start it is of its own company, so that its first edges are scored."""
    forward = edges.select(F.col("node").alias("at"), F.col("near").alias("who"), "fresh")
    back = edges.select(F.col("near").alias("at"), F.col("node").alias("who"), "fresh").withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "who"))))
    company = forward.union(back.where(F.col("r") <= REVERSE).drop("r"))
    if start:
        company = company.union(nodes.select(F.col("node").alias("at"), F.col("node").alias("who"), F.lit(True).alias("fresh")))
    worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    known = nodes.select("node", "u").join(worst, "node", "left").select(F.col("node").alias("who"), "u", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    sent = company.join(known, "who")
    groups = sent.groupBy("at").agg(F.collect_list(F.struct("who", "u", "worst", "fresh")).alias("m"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m in batch["m"]:
                who = np.array([x["who"] for x in m])
                who, first = np.unique(who, return_index=True)
                if len(who) < 2:
                    continue
                u = np.frombuffer(b"".join([m[i]["u"] for i in first]), np.float16).reshape(len(who), -1).astype(np.float32)
                fresh = np.zeros(len(who), bool)
                for i, x in enumerate(m):
                    if x["fresh"]:
                        fresh[np.searchsorted(who, x["who"])] = True
                worst = np.array([m[i]["worst"] for i in first], np.float32)
                sim = u @ u.T
                sim[~(fresh[:, None] | fresh[None, :])] = -3
                np.fill_diagonal(sim, -3)
                sim[sim <= worst[:, None]] = -3
                k = min(NEWS, len(who) - 1)
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(sim, top, 1)
                i, j = np.nonzero(best > -3)
                if len(i):
                    out.append((who[i], who[top[i, j]], best[i, j]))
            if out:
                yield pd.DataFrame({"node": np.concatenate([x[0] for x in out]), "near": np.concatenate([x[1] for x in out]), "sim": np.concatenate([x[2] for x in out])})

    return groups.mapInPandas(compared, EDGE)


def merged(edges: DataFrame, news: DataFrame) -> DataFrame:
    """The K best neighbours of each node; fresh ones were not among its neighbours."""
    both = edges.select("node", "near", "sim", F.lit(0).alias("new")).union(news.select("node", "near", "sim", F.lit(1).alias("new")))
    single = both.groupBy("node", "near").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    ranked = single.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "near"))).where(F.col("r") <= K)
    return ranked.select("node", "near", "sim", (F.col("new") == 1).alias("fresh"))


def released(spark: SparkSession) -> None:
    """Let the JVM drop shuffle files of finished iterations now, not at its next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def graph(nodes: DataFrame) -> DataFrame:
    """Edges (node, near, sim) of the neighbour graph."""
    spark = nodes.sparkSession
    n = nodes.count()
    edges = common.saved(started(nodes, n), "nn-edges")
    start = True
    while True:
        news = common.saved(local_join(edges, nodes, start), "nn-news", batch=256)
        after = common.saved(merged(edges.where("sim > -2") if start else edges, news), "nn-edges")
        common.dropped(edges, news)
        edges, start = after, False
        released(spark)
        if edges.where("fresh").count() <= STILL * n:
            return edges.select("node", "near", "sim")


FOUND = "query long, near long, sim float"


def searched(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (query, near, sim) of each query node after greedy search. queries: node."""
    spark = nodes.sparkSession
    around = edges.join(nodes.select(F.col("node").alias("near"), "u"), "near").groupBy("node").agg(F.collect_list("near").alias("nears"), F.collect_list("u").alias("us"))
    around = common.saved(around, "nn-around")
    vectors = queries.join(nodes, "node").select(F.col("node").alias("query"), "u")
    beam = edges.join(queries, "node", "left_semi").select(F.col("node").alias("query"), "near", "sim", F.lit(False).alias("seen"))
    beam = common.saved(beam, "nn-beam")

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, u, worst, nears, us in zip(b["query"], b["u"], b["worst"], b["nears"], b["us"], strict=True):
                x = np.frombuffer(b"".join(us), np.float16).reshape(len(us), -1).astype(np.float32)
                sim = x @ np.frombuffer(u, np.float16).astype(np.float32)
                near = np.asarray(nears)
                ok = (sim > worst) & (near != query)
                out.append((np.full(int(ok.sum()), query), near[ok], sim[ok]))
            if out:
                yield pd.DataFrame({"query": np.concatenate([o[0] for o in out]), "near": np.concatenate([o[1] for o in out]), "sim": np.concatenate([o[2] for o in out])})

    while True:  # every step visits all that is unvisited in the beams, which only get nearer
        todo = beam.where("NOT seen").select("query", F.col("near").alias("node"))
        worst = beam.groupBy("query").agg(F.when(F.count(F.lit(1)) >= BEAM, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
        asked = todo.join(vectors, "query").join(worst, "query")
        found = asked.join(around, "node").select("query", "u", "worst", "nears", "us").mapInPandas(looked, FOUND)
        both = beam.select("query", "near", "sim", F.lit(1).alias("seen")).union(found.select("query", "near", "sim", F.lit(0).alias("seen")))
        single = both.groupBy("query", "near").agg(F.max("sim").alias("sim"), F.max("seen").alias("seen"))
        ranked = single.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "near"))).where(F.col("r") <= BEAM)
        after = common.saved(ranked.select("query", "near", "sim", (F.col("seen") == 1).alias("seen")), "nn-beam", batch=512)
        common.dropped(beam)
        beam = after
        if beam.where("NOT seen").isEmpty():
            return beam


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, asked: Column) -> DataFrame:
    """query_id, rank, vec_id and score of the NEAREST of each row for which ``asked`` (a condition on vec_id) holds."""
    rows = common.saved(usable(vectors), "nn-rows")
    nodes, members = nodes_of(rows)
    members = common.saved(members, "nn-classes")
    keys = common.saved(rows.select(F.md5(F.to_json("v")).alias("key"), "vec_id").where(asked).distinct(), "nn-asked")
    heads = nodes.select("node", F.md5(F.to_json("v")).alias("key"))
    queries = common.saved(keys.join(heads, "key").select("vec_id", "node"), "nn-queries")
    edges = graph(nodes)
    beam = searched(queries.select("node").distinct(), nodes, edges)
    close = beam.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "near"))).where(F.col("r") <= 4 * NEAREST).select("query", "near")
    own = queries.select(F.col("node").alias("query")).distinct()
    close = close.union(own.select("query", F.col("query").alias("near")))
    a = nodes.select(F.col("node").alias("query"), F.col("v").alias("qv"))
    b = nodes.select(F.col("node").alias("near"), F.col("v").alias("nv"))
    scored = common.saved(close.join(a, "query").join(b, "near").select("query", "near", cosine(F.col("qv"), F.col("nv")).alias("score")), "nn-scored")
    ids = scored.join(members.select(F.col("node").alias("near"), "vec_id"), "near").select("query", "vec_id", "score")
    best = ids.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= NEAREST + 1 + NEAREST)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    return answered(queries, lists)


def answered(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """The NEAREST of each query from the list of its node. queries: vec_id, node; lists: query (a node), best.

    Nodes that many queries share are dealt in parts, each with its own copy of the list. They hold more than one in ``PARTS`` of all queries
    each, so that there are fewer than ``PARTS`` of them to broadcast.
    """
    total = queries.count()
    hot = queries.groupBy("node").count().where(F.col("count") * PARTS > total)
    hot = F.broadcast(hot.select("node", F.ceil(F.col("count") * PARTS / F.lit(max(total, 1))).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asked = queries.join(hot, "node", "left").select("node", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))
    copies = lists.withColumnRenamed("query", "node").join(hot, "node", "left").select("node", "best", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, NEAREST)
    found = asked.join(copies, ["node", "part"]).select("query_id", F.posexplode(others).alias("place", "x"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
