"""Near-duplicate embeddings by a flat robust-pruned graph.

Vectors of one label are compared by cosine. Equal vectors are one node with a count, never pairs.

1. ``sharded``: nodes of a label (and length) are dealt into overlapping shards. A shard of over ``LIMIT`` nodes takes
   pivots from a sample of about ``SAMPLE`` of its nodes, chosen by hash, far from each other; each node goes on to its
   ``COPIES`` nearest pivots. This repeats until all shards fit, ``SPLITS`` times at most. A shard that is still too
   large or has no distinct pivots is one tight bunch: it is cut into parts by hash, and every two parts make a shard,
   which loses no pair.
2. ``searched``: each shard builds a graph in its task (neighbour lists by robust pruning, links both ways) and searches
   it for every node from the medoid, expanding through everything in range. It gives the links, verified in double
   precision, and its near neighbour lists.
3. ``linked``: lists and links of all shards are united. Nodes that share no shard but are both near a third are met by
   expanding over the united lists, which are short: of two nodes linked through a third, the list entry is within
   twice the range, so only such entries are kept. Candidates are verified, until a round finds nothing.
4. ``audit``: of every label that was split, and of all others together, about ``AUDIT`` nodes, chosen by hash, are
   compared with all nodes of their label, and eight times as many each time until ``LINKING`` of them have links or
   all nodes are asked. Labels of which fewer than ``RECALL`` of these links were found are done again with one more
   copy per node; what misses the bound three times is compared exactly, block by block.

Links give components; rows get their node's component and count links to other rows, equal vectors included.

Edge cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, links with
nothing and is its own component; vectors of different lengths do not link; repeated rows count as other vectors of
the same content; a component's id is its smallest vec_id, null only if it has no other; an empty table gives no rows.
Columns other than ``vec_id``, ``label`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm import vectorgraph
from rotorline.llm.base import cut, table
from rotorline.llm.components import components

COSINE = 0.98
LIMIT, TARGET, SAMPLE, COPIES = 750, 500, 128, 2  # shards of one size for labels of any size: the work a node is the same
APART, SPLITS = 0.9, 3  # pivots have a lower cosine than this
AUDIT, LINKING, RECALL = 200, 100, 0.97
BLOCK = 2048


def usable(embedding: Column) -> Column:
    good = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & good & F.exists(embedding, lambda v: v != 0), F.lit(False))


def node_of() -> Column:
    return F.when(usable(F.col("embedding")), F.xxhash64(F.col("label"), F.col("embedding")))


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, shard (at first label and length), embedding, first (smallest vec_id), rows."""
    named = vectors.select("vec_id", "label", "embedding", node_of().alias("node")).where("node is not null")
    shard = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    return named.groupBy("node").agg(F.first(shard).alias("shard"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("rows"))


def _pivots(copies: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of a sampled shard: as many vectors as it needs parts, each the farthest from those before; none if the
        shard is a tight bunch, for which too few are apart, or has been split ``SPLITS`` times in vain."""
        x, shard, size = unit(rows["embedding"]), rows["shard"].iloc[0], rows["size"].iloc[0]
        wanted = int(np.clip(np.ceil(copies * size / TARGET), 2 * copies, 64))
        chosen = [int(np.argmax(x @ x.mean(0)))]
        near = x @ x[chosen[0]]
        while len(chosen) < wanted and near.min() < APART:
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[chosen[-1]])
        if len(chosen) < 2 * copies or shard.count("/") > SPLITS:
            chosen = []
        return pd.DataFrame({"shard": [shard], "size": [size], "pivots": [[x[i].tolist() for i in chosen]]})

    return run


def _dealt(copies: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, rows in batch.groupby("shard"):
                pivots = rows["pivots"].iloc[0]
                if not len(pivots):
                    # A tight bunch: parts by hash, and a shard for every two parts.
                    parts = max(2, int(np.ceil(2 * rows["size"].iloc[0] / LIMIT)))
                    part = rows["node"].to_numpy() % parts
                    for other in range(parts):
                        low, high = np.minimum(part, other), np.maximum(part, other)
                        keep = part != other
                        out.append(pd.DataFrame({"node": rows["node"].to_numpy()[keep], "shard": [f"{shard}/={a}:{b}" for a, b in zip(low[keep], high[keep], strict=True)], "embedding": rows["embedding"].to_numpy()[keep]}))
                    continue
                near = np.argsort(-(unit(rows["embedding"]) @ np.array([list(p) for p in pivots]).T), axis=1)[:, :copies]
                for k in range(near.shape[1]):
                    out.append(pd.DataFrame({"node": rows["node"].to_numpy(), "shard": [f"{shard}/{p}" for p in near[:, k]], "embedding": rows["embedding"].to_numpy()}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def sharded(nodes: DataFrame, copies: int = COPIES, limit: int = LIMIT) -> DataFrame:
    """node, shard, embedding: each node in every shard it is dealt to; final shards have at most about ``limit`` nodes."""
    shape = f"node long, shard string, embedding {nodes.schema['embedding'].dataType.simpleString()}"
    going, done = nodes.select("node", "shard", "embedding"), None
    while True:
        sizes = cut(going.groupBy("shard").agg(F.count("*").alias("size")))
        large = sizes.where((F.col("size") > limit) & ~F.col("shard").contains("="))
        if large.isEmpty():
            return going if done is None else done.unionByName(going)
        fits = going.join(large, "shard", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        marked = going.join(large, "shard")
        sample = marked.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("size")) < SAMPLE)
        pivots = cut(sample.groupBy("shard").applyInPandas(_pivots(copies), "shard string, size long, pivots array<array<double>>"))
        going = cut(going.join(pivots, "shard").select("node", "shard", "embedding", "size", "pivots").mapInPandas(_dealt(copies), shape).dropDuplicates(["node", "shard"]))


def _search(cosine: float):
    reach = 2 - 2 * cosine
    wide = 4 * reach  # twice the distance

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, exact = rows["node"].to_numpy(), unit(rows["embedding"])
        if len(ids) < 2:
            return pd.DataFrame({"a": [], "b": [], "linked": [], "listed": []})
        x = exact.astype(np.float32)
        graph, medoid = vectorgraph.build(x)
        left, right = vectorgraph.in_range(x, graph, medoid, reach + 1e-5)
        source, slot = np.nonzero(graph >= 0)
        target = graph[source, slot]
        near = 2 - 2 * np.einsum("nd,nd->n", x[source], x[target]) <= wide + 1e-5
        cos = np.concatenate([np.einsum("nd,nd->n", exact[left[i:i + 65536]], exact[right[i:i + 65536]]) for i in range(0, max(len(left), 1), 65536)])
        left, right = left[cos >= cosine], right[cos >= cosine]
        return pd.DataFrame({"a": np.concatenate([ids[left], ids[source[near]]]), "b": np.concatenate([ids[right], ids[target[near]]]),
                             "linked": np.repeat([True, False], [len(left), near.sum()]), "listed": np.repeat([False, True], [len(left), near.sum()])})

    return run


def searched(shards: DataFrame, cosine: float) -> DataFrame:
    """a, b, linked, listed: links that a shard's search found, and near entries of its neighbour lists; a < b, united."""
    found = shards.groupBy("shard").applyInPandas(_search(cosine), "a long, b long, linked boolean, listed boolean")
    return found.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("linked").alias("linked"), F.max("listed").alias("listed"))


def cosine_of(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def linked(shards: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a, b: verified links, a < b."""
    united = cut(searched(shards, cosine))
    links = united.where("linked").select("a", "b")
    homes = cut(shards.groupBy("node").agg(F.collect_set("shard").alias("homes"), F.first("embedding").alias("embedding")))
    # Only nodes at the seams can have missed each other: both ends of a pair without a common shard.
    both = lambda pairs: pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = lambda name: homes.select(F.col("node").alias(name), F.col("homes").alias(f"{name}_homes"))
    entries = both(united.where("listed")).join(at("a"), "a").join(at("b"), "b")
    seam = cut(entries.where(F.size(F.array_except("b_homes", "a_homes")) > 0).select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("b_homes").alias("z_homes")))
    # A node goes out over its own list first, then over the lists of what it has found beyond the seam.
    fresh = united.where("linked and listed").select("a", "b")
    while True:
        steps = both(fresh).select(F.col("a").alias("x"), F.col("b").alias("y")).join(at("x"), "x")
        met = steps.join(seam, "y").where((F.col("x") < F.col("z")) & ~F.arrays_overlap("x_homes", "z_homes")).select(F.col("x").alias("a"), F.col("z").alias("b")).distinct()
        new = met.join(links, ["a", "b"], "left_anti")
        u, v = (homes.select(F.col("node").alias(n), F.col("embedding").alias(f"{n}_embedding")) for n in "ab")
        fresh = cut(new.join(u, "a").join(v, "b").where(cosine_of(F.col("a_embedding"), F.col("b_embedding")) >= cosine).select("a", "b"))
        if fresh.isEmpty():
            return links
        links = cut(links.union(fresh))


def compared(nodes: DataFrame, asked: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a (asked), b: all links of the asked nodes to nodes of their label, by comparing blocks of ``BLOCK`` nodes."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows, others = block[block["asks"]], block[~block["asks"]]
        if not len(rows) or not len(others):
            return pd.DataFrame({"a": [], "b": []})
        i, j = np.nonzero(unit(rows["embedding"]) @ unit(others["embedding"]).T >= cosine)
        return pd.DataFrame({"a": rows["node"].to_numpy()[i], "b": others["node"].to_numpy()[j]})

    parts = lambda df, name: df.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    plan = cut(parts(asked, "of_asked").join(parts(nodes, "of_nodes"), "shard"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("node", F.lit("block")), F.col(name)).cast("int")
    left = asked.join(plan, "shard").select("shard", own("of_asked").alias("i"), every("of_nodes").alias("j"), "node", "embedding", F.lit(True).alias("asks"))
    right = nodes.join(plan, "shard").select("shard", every("of_asked").alias("i"), own("of_nodes").alias("j"), "node", "embedding", F.lit(False).alias("asks"))
    return left.unionByName(right).groupBy("shard", "i", "j").applyInPandas(run, "a long, b long").where("a <> b")


def audit(nodes: DataFrame, links: DataFrame, shards: DataFrame, cosine: float = COSINE, queries: int = AUDIT, linking: int = LINKING) -> DataFrame:
    """shard (label and length), true, found: of every audited stratum's asked nodes the true links, and those in ``links``.

    A label that was split is a stratum, all others together are one. ``queries`` nodes of a stratum are asked, then
    eight times as many, until ``linking`` of them have true links or all its nodes are asked.
    """
    dealt = shards.select("node", F.col("shard").alias("dealt")).join(nodes.select("node", "shard"), "node").where("dealt <> shard")
    split = dealt.select("shard", F.col("shard").alias("split")).distinct()
    strata = cut(nodes.groupBy("shard").agg(F.count("*").alias("size")).join(split, "shard", "left").withColumn("stratum", F.coalesce("split", F.lit(""))).drop("split"))
    sizes = strata.groupBy("stratum").agg(F.sum("size").alias("total"))
    strata = cut(strata.join(sizes, "stratum").select("shard", "stratum", "total"))
    done, going = None, strata
    while not going.isEmpty():
        here = nodes.join(going, "shard").select("node", "shard", "embedding", "stratum", "total")
        asked = here.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.col("total")) < queries).select("node", "shard", "embedding")
        true = cut(compared(here.select("node", "shard", "embedding"), asked, cosine))
        pairs = true.select(F.col("a").alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = pairs.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("node").agg(F.count("*").alias("true"), F.count("hit").alias("found"))
        named = met.join(nodes.select("node", "shard"), "node").join(going, "shard")
        sums = named.groupBy("stratum").agg(F.sum("true").alias("true"), F.sum("found").alias("found"), F.count("*").alias("linking"))
        state = cut(going.join(sums, "stratum", "left").fillna(0, ["true", "found", "linking"]))
        enough = (F.col("linking") >= linking) | (F.col("total") <= queries)
        ready = state.where(enough).select("shard", "true", "found")
        done = ready if done is None else done.unionByName(ready)
        going = state.where(~enough).select("shard", "stratum", "total")
        queries *= 8
    return cut(done if done is not None else strata.select("shard", F.lit(0).alias("true"), F.lit(0).alias("found")))


def links_of(nodes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """a, b: verified links, a < b. Labels that miss the audit are done again, and at last compared exactly."""
    kept, left = None, nodes
    for copies in range(COPIES, COPIES + 3):
        shards = cut(sharded(left, copies))
        links = cut(linked(shards, cosine))
        missed = cut(audit(left, links, shards, cosine).where(F.col("found") < recall * F.col("true")).select("shard"))
        again = cut(left.join(missed, "shard", "left_semi"))
        good = links if again.isEmpty() else links.join(again.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b")
        kept = good if kept is None else kept.union(good)
        left = again
        if left.isEmpty():
            return kept
    return kept.union(compared(left, left, cosine).where("a < b").select("a", "b"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id."""
    nodes = cut(nodes_of(vectors))
    links = cut(links_of(nodes, cosine, recall))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(nodes.select(F.col("node").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("more"))
    reached = components(links)
    rooted = nodes.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    solved = rooted.join(smallest, "root").join(degree, rooted["node"] == degree["a"], "left").select(
        "node", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    # A row that cannot link has no node; a key of its own keeps such rows apart in the join.
    row = vectors.select("vec_id", node_of().alias("own")).withColumn("node", F.coalesce("own", F.xxhash64("vec_id", F.lit("alone"))))
    return row.join(solved, "node", "left").select(
        "vec_id", F.when(F.col("own").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("own").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach(a, b) AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
SELECT vec_id, (SELECT count(*) FROM pair WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM embeddings
"""
