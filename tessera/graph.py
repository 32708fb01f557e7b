"""Static graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import digest, lcg
from tessera.operators.hot_keys import number_rows
from tessera.schema import require
from tessera.session import materialize


@dataclass(frozen=True)
class PropertyGraph:
    """``edges(src, dst[, weight])`` and ``nodes(id, ...)``.

    An undirected graph stores both directions of every edge, so counts of
    edges count each of them twice.
    """

    edges: DataFrame
    nodes: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(
        edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, weight: str | None = None, symmetric: bool = False
    ) -> PropertyGraph:
        """A graph from an edge list.

        Undirected input gets its reverse direction added unless it is
        ``symmetric`` already; a loop is stored once.  Rows with a null end are
        no edges.  Without a node table the nodes are the ends of the edges.
        A weight column must be filled everywhere or nowhere; if it is null
        everywhere the graph is unweighted.
        """
        require(edges, "src", "dst", *([weight] if weight else []))
        columns = ["src", "dst"]
        rows = edges.where("src is not null and dst is not null")
        if weight:
            n, given = rows.agg(F.count(F.lit(1)), F.count(weight)).first()
            if given not in (0, n):
                raise RuntimeError("some edges have missing weight")
            if given:
                rows = rows.withColumn("weight", F.col(weight).cast("double"))
                columns.append("weight")
        rows = rows.select(F.col("src").cast("long"), F.col("dst").cast("long"), *columns[2:])
        if not directed and not symmetric:
            turned = rows.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns[2:])
            rows = rows.unionByName(turned)
        if nodes is None:
            nodes = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
        return PropertyGraph(rows, require(nodes, "id"), directed)

    # -- properties ---------------------------------------------------------

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @cached_property
    def num_edges(self) -> int:
        return self.edges.count()

    @cached_property
    def num_nodes(self) -> int:
        return self.nodes.count()

    @property
    def feature_columns(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in ("id", "label", "y")]

    @property
    def has_node_labels(self) -> bool:
        return "label" in self.nodes.columns

    @property
    def weighted_edges(self) -> DataFrame:
        """``src, dst, weight`` with weight 1 where there is none."""
        weight = F.col("weight") if self.weighted else F.lit(1.0)
        return self.edges.select("src", "dst", weight.alias("weight"))

    # -- degrees and neighbours ----------------------------------------------

    def degree(self) -> DataFrame:
        """``id, degree``: edges out of every node, 0 included."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def strength(self) -> DataFrame:
        """``id, strength``: weight out of every node; the degree if unweighted."""
        out = self.weighted_edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
        return self.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def neighbours_of(self, node: int) -> DataFrame:
        """``dst, weight`` of the edges out of one node."""
        return self.weighted_edges.where(F.col("src") == node).select("dst", "weight")

    def adjacency(self) -> DataFrame:
        """``src, position, dst, weight``: neighbours in id order, position from 0."""
        order = Window.partitionBy("src").orderBy("dst", "weight")
        return self.weighted_edges.withColumn("position", (F.row_number().over(order) - 1).cast("long")).select("src", "position", "dst", "weight")

    def neighbours(self, seeds: DataFrame) -> DataFrame:
        """``id``: the distinct neighbours of a set of ids; may hold some of the set."""
        return self.edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()

    def is_edge(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with a boolean ``is_edge``; unknown ids and nulls give false."""
        known = self.edges.select("src", "dst", F.lit(True).alias("is_edge")).distinct()
        return pairs.join(known, ["src", "dst"], "left").withColumn("is_edge", F.coalesce("is_edge", F.lit(False)))

    def is_symmetric(self) -> bool:
        """Whether the edge multiset equals its transpose, weights included."""
        rows = self.weighted_edges
        turned = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        signed = rows.withColumn("s", F.lit(1)).unionByName(turned.withColumn("s", F.lit(-1)))
        return signed.groupBy("src", "dst", "weight").agg(F.sum("s").alias("s")).where("s <> 0").isEmpty()

    def k_hop(self, seeds: DataFrame, hops: int) -> DataFrame:
        """``id, hop``: the seeds at hop 0 and nodes first reached over out-edges at 1..hops."""
        visited = materialize(seeds.select(F.col("id").cast("long")).distinct().withColumn("hop", F.lit(0)), "hop")
        frontier = visited
        for hop in range(1, hops + 1):
            reached = (
                self.edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
                .select(F.col("dst").alias("id"))
                .distinct()
                .join(visited.select("id"), "id", "left_anti")
                .withColumn("hop", F.lit(hop))
            )
            frontier = materialize(reached, "hop")
            visited = visited.unionByName(frontier)
        return visited

    # -- subgraphs -------------------------------------------------------------

    def induced(self, nodes: DataFrame, relabel: bool = False) -> PropertyGraph:
        """The edges with both ends in ``nodes`` and the rows of these nodes.

        With ``relabel`` the ids become positions 0.. in ascending order of the
        old ids, or of a column ``position`` if there is one; the old id stays
        in column ``label``.  Repeated ids count once.
        """
        chosen = nodes.select("id", *[c for c in ["position"] if c in nodes.columns]).dropDuplicates(["id"])
        ids = chosen.select("id")
        edges = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(
            ids.select(F.col("id").alias("dst")), "dst", "left_semi"
        )
        rows = self.nodes.join(ids, "id", "left_semi")
        edges = edges.select(*self.edges.columns)
        if not relabel:
            return PropertyGraph(edges, rows, self.directed)
        order = ["position", "id"] if "position" in chosen.columns else ["id"]
        numbers = dense_ids(chosen, *order)
        weight = [c for c in edges.columns if c == "weight"]
        renamed = (
            edges.join(numbers.select(F.col("id").alias("src"), F.col("new_id").alias("new_src")), "src")
            .join(numbers.select(F.col("id").alias("dst"), F.col("new_id").alias("new_dst")), "dst")
            .select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *weight)
        )
        labelled = rows.drop("label").join(numbers, "id").withColumnRenamed("id", "label").withColumnRenamed("new_id", "id")
        return PropertyGraph(renamed, labelled, self.directed)

    def induced_with_hops(self, nodes: DataFrame, hops: int = 0, relabel: bool = False) -> PropertyGraph:
        """The induced subgraph after the set is extended by nodes that lead into it within ``hops`` edges."""
        if hops:
            turned = PropertyGraph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.nodes, self.directed)
            nodes = turned.k_hop(nodes, hops).select("id")
        return self.induced(nodes, relabel)

    def quotient(self, partition: DataFrame, self_loops: bool = False) -> PropertyGraph:
        """The graph of clusters: ``src, dst, weight`` with the number of edges between them.

        ``partition(node, cluster)``; edge weights don't matter.  All clusters
        are nodes, also those without edges.
        """
        edges = (
            self.edges.join(partition.select(F.col("node").alias("src"), F.col("cluster").alias("c_src")), "src")
            .join(partition.select(F.col("node").alias("dst"), F.col("cluster").alias("c_dst")), "dst")
            .groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
            .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        )
        if not self_loops:
            edges = edges.where("src <> dst")
        return PropertyGraph(edges, partition.select(F.col("cluster").alias("id")).distinct(), self.directed)

    # -- measures and samples ----------------------------------------------------

    def conductance(self, source: DataFrame, target: DataFrame | None = None) -> float | None:
        """Edges from source to target over the smaller of their volumes.

        Volumes are unweighted out-degrees.  Without a target it is the
        complement of the source.  None if the smaller volume is 0.
        """
        s = source.select(F.col("id").alias("src")).distinct().withColumn("in_s", F.lit(1))
        t = (source if target is None else target).select(F.col("id")).distinct().withColumn("in_t", F.lit(1))
        marked = (
            self.edges.join(s, "src", "left")
            .join(t.select(F.col("id").alias("src"), F.col("in_t").alias("src_t")), "src", "left")
            .join(t.select(F.col("id").alias("dst"), F.col("in_t").alias("dst_t")), "dst", "left")
        )
        to_target = F.col("dst_t").isNull() if target is None else F.col("dst_t").isNotNull()
        of_target = F.col("src_t").isNull() if target is None else F.col("src_t").isNotNull()
        in_source = F.col("in_s").isNotNull()
        row = marked.agg(
            F.sum((in_source & to_target).cast("long")), F.sum(in_source.cast("long")), F.sum(of_target.cast("long"))
        ).first()
        smaller = min(row[1] or 0, row[2] or 0)
        return row[0] / smaller if smaller else None

    def cluster_conductance(self, partition: DataFrame) -> DataFrame:
        """``cluster, cut, volume, conductance`` of every cluster against the rest."""
        marked = self.edges.join(partition.select(F.col("node").alias("src"), F.col("cluster")), "src").join(
            partition.select(F.col("node").alias("dst"), F.col("cluster").alias("other")), "dst"
        )
        each = marked.groupBy("cluster").agg(F.sum((F.col("cluster") != F.col("other")).cast("long")).alias("cut"), F.count(F.lit(1)).alias("volume"))
        total = self.num_edges
        smaller = F.least(F.col("volume"), F.lit(total) - F.col("volume"))
        return each.withColumn("conductance", F.when(smaller > 0, F.col("cut") / smaller))

    def sample_edges(self, k: int, seed: int = 1) -> DataFrame:
        """``draw, src, dst``: k edges drawn uniformly with replacement."""
        numbered = number_rows(materialize(self.edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), "edges"))
        m = self.num_edges
        draws = self.edges.sparkSession.range(k).select(F.col("id").alias("draw"), (digest(seed, F.col("id")) % F.lit(max(m, 1))).alias("row_no"))
        return draws.join(numbered, "row_no").select("draw", "src", "dst")

    def sample_non_edges(self, k: int, seed: int = 1) -> DataFrame:
        """``draw, src, dst``: k uniform pairs of different nodes that are no edge.

        Pairs are drawn with replacement and rejected if they are edges, with
        as many rounds as it takes; a complete graph raises ``ValueError``.
        """
        spark = self.edges.sparkSession
        numbered = materialize(dense_ids(self.nodes.select("id"), "id"), "node-numbers")
        n = self.num_nodes
        free = n * (n - 1) - self.edges.where("src <> dst").select("src", "dst").distinct().count()
        if k and free < 1:
            raise ValueError("every pair of nodes is an edge")
        found, have, start = None, 0, 0
        while have < k:
            tries = min(int((k - have) * 1.2 * max(1.0, n * (n - 1) / free)) + 16, 1 << 40)
            drawn = spark.range(start, start + tries).select(
                F.col("id").alias("draw"),
                (digest(seed, F.col("id")) % F.lit(n)).alias("a"),
                (digest(seed + 1, F.col("id")) % F.lit(n)).alias("b"),
            ).where("a <> b")
            pairs = (
                drawn.join(numbered.select(F.col("new_id").alias("a"), F.col("id").alias("src")), "a")
                .join(numbered.select(F.col("new_id").alias("b"), F.col("id").alias("dst")), "b")
                .select("draw", "src", "dst")
                .join(self.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
            )
            pairs = materialize(pairs.select("draw", "src", "dst"), "non-edges")
            found = pairs if found is None else found.unionByName(pairs)
            have, start = have + pairs.count(), start + tries
        if found is None:
            return spark.createDataFrame([], "draw long, src long, dst long")
        return found.orderBy("draw").limit(k)


def dense_ids(ids: DataFrame, *order: str) -> DataFrame:
    """``id, new_id``: positions 0.. in the given order, numbered across range partitions."""
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    return number_rows(materialize(ordered, "dense-ids")).select("id", F.col("row_no").alias("new_id"))


def hashed_pairs(n: DataFrame, seed: int) -> DataFrame:
    """``n`` with a column ``u`` of the linear congruential hash of its id."""
    return n.withColumn("u", lcg(F.col("id"), seed))
