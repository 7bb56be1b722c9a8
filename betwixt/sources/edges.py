"""Readers and writers: edge lists, feature tables, probabilities, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ["log_degree", "degree_centrality", "log_nb_avg_deg", "nb_max_deg_norm", "clustering", "log_reach2", "reach2_norm", "deg_over_avg"]
NODE_SCHEMA = T.StructType([T.StructField("node", T.LongType()), T.StructField("bc", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
BC_SCHEMA = T.StructType([T.StructField("node", T.LongType()), T.StructField("bc", T.DoubleType())])
PROBS_SCHEMA = T.StructType([T.StructField("target", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prob", T.DoubleType())])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of every line that starts with two whole numbers; comment, blank and malformed lines are skipped.

    Duplicates, loops and directions are kept: this is the multigraph form.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (
        spark.read.text(path)
        .filter(~F.trim(F.col("value")).startswith("#"))
        .select(F.get(parts, F.lit(0)).try_cast("long").alias("a"), F.get(parts, F.lit(1)).try_cast("long").alias("b"))
        .dropna()
    )


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct undirected pairs a < b without loops."""
    return pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def symmetric(pairs: DataFrame) -> DataFrame:
    """Directed edges (src, dst) both ways."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def read_graph(spark: SparkSession, path: str, one_indexed: bool = False, multigraph: bool = False) -> DataFrame:
    """Edges (src, dst) of an edge list; ids are the file's, shifted down by one if ``one_indexed``."""
    pairs = read_pairs(spark, path)
    if one_indexed:
        pairs = pairs.select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"))
    return symmetric(pairs if multigraph else canonical(pairs))


def raw_nodes(edges: DataFrame) -> DataFrame:
    """All ids from 0 to the largest, also isolated ones."""
    top = edges.agg(F.max("src").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("node"))


def tsv_to_edges(spark: SparkSession, source: str, target: str) -> None:
    """The first two tab-separated columns as a space-separated edge list."""
    parts = F.split("value", "\t")
    spark.read.text(source).filter(F.size(parts) >= 2).select(F.concat_ws(" ", parts[0], parts[1])).write.mode("overwrite").text(target)


def read_node_table(spark: SparkSession, csv: str, edges: str, least_nodes: int = 0) -> tuple[DataFrame, DataFrame] | None:
    """Node features with their edges, both ends of which must be nodes; None if there are too few."""
    nodes = spark.read.schema(NODE_SCHEMA).csv(csv, header=True)
    if nodes.limit(max(1, least_nodes)).count() < max(1, least_nodes):
        return None
    known = nodes.select("node").distinct()
    pairs = canonical(read_pairs(spark, edges))
    for end in ("a", "b"):
        pairs = pairs.join(known.withColumnRenamed("node", end), end, "left_semi")
    return nodes, symmetric(pairs.select("a", "b"))


def read_edge_files(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, src, dst), both ways, of all <graph_id>_edges.txt of a folder; loops and repeated edges are left out."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.option("pathGlobFilter", "*_edges.txt").text(folder)
    rows = lines.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_edges\.txt$", 1).alias("graph_id"),
        F.get(words, F.lit(0)).try_cast("long").alias("a"),
        F.get(words, F.lit(1)).try_cast("long").alias("b"),
    ).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = rows.select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return pairs.unionByName(pairs.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def read_node_tables(spark: SparkSession, folder: str, least_nodes: int = 20, most_graphs: int | None = None, with_edges: bool = False) -> DataFrame:
    """All graph_<k>.csv and real_*.csv of a folder with graph_id from the file's name; small graphs are left out.

    ``with_edges`` also leaves out graphs that have no file of edges.
    """
    rows = (
        spark.read.schema(NODE_SCHEMA)
        .option("pathGlobFilter", "{graph_*[0-9],real_*}.csv")
        .csv(folder, header=True)
        .withColumn("graph_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    )
    sizes = rows.groupBy("graph_id").count().filter(F.col("count") >= least_nodes).select("graph_id")
    if with_edges:
        sizes = sizes.join(read_edge_files(spark, folder).select("graph_id").distinct(), "graph_id", "left_semi")
    if most_graphs is not None:
        sizes = sizes.orderBy("graph_id").limit(most_graphs)
    return rows.join(sizes, "graph_id", "left_semi")


def normalised(probs: DataFrame, p: str = "prob") -> DataFrame:
    """Each target's probabilities divided by their sum; targets of sum 0 are dropped."""
    total = probs.groupBy("target").agg(F.sum(p).alias("__total")).filter(F.col("__total") > 0)
    return probs.join(total, "target").withColumn(p, F.col(p) / F.col("__total")).drop("__total")


def read_probabilities(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(target, node, prob): nodes from 0 to n - 1, the last line of repeated ones, renormalised."""
    rows = spark.read.schema(PROBS_SCHEMA).csv(path, header=True).withColumn("__line", F.monotonically_increasing_id())
    last = rows.filter((F.col("node") >= 0) & (F.col("node") < n)).groupBy("target", "node").agg(F.max_by("prob", "__line").alias("prob"))
    return normalised(last)


def read_bc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BC_SCHEMA).csv(path, header=True)


def fingerprint(edges: DataFrame) -> str:
    """Equal for equal edge sets, whatever their order."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("dst", "src") % 1000003)).first()
    return "-".join("0" if x is None else format(x & 0xFFFFFFFFFFFFFFFF, "x") for x in r)


def cached_bc(edges: DataFrame, folder: str, compute) -> DataFrame:
    """Betweenness of ``edges`` from a Parquet cache keyed by their fingerprint; computed and stored if missing."""
    spark = edges.sparkSession
    path = f"{folder.rstrip('/')}/bc-{fingerprint(edges)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        compute(edges).write.mode("overwrite").parquet(path)
    return spark.read.schema(BC_SCHEMA).parquet(path)


def decimals(col: str, n: int = 10) -> Column:
    return F.col(col).cast(f"decimal(38,{n})").cast("string").alias(col)


def write_edges(edges: DataFrame, path: str, header: list[str] | None = None, sep: str = " ") -> None:
    """``u v`` with u < v, sorted; with ``header``, comment lines first (all in one file then)."""
    lines = edges.filter(F.col("src") < F.col("dst")).distinct()
    if header:
        spark = edges.sparkSession
        top = spark.createDataFrame([(i - len(header), f"# {h}") for i, h in enumerate(header)], "o long, line string")
        body = lines.select(F.col("src").alias("o"), F.concat_ws(sep, "src", "dst").alias("line"), "dst")
        top.withColumn("dst", F.lit(0).cast("long")).unionByName(body).coalesce(1).sortWithinPartitions("o", "dst").select("line").write.mode("overwrite").text(path)
    else:
        lines.orderBy("src", "dst").select(F.concat_ws(sep, "src", "dst")).write.mode("overwrite").text(path)


def write_bc(bc: DataFrame, path: str) -> None:
    bc.select("node", decimals("bc")).write.mode("overwrite").csv(path, header=True)


def write_features(nodes: DataFrame, path: str) -> None:
    nodes.select("node", decimals("bc"), *FEATURES).write.mode("overwrite").csv(path, header=True)


def write_probabilities(probs: DataFrame, path: str, p: str = "prob") -> None:
    """``target,node,prob`` lines."""
    probs.select("target", "node", F.col(p).alias("prob")).write.mode("overwrite").csv(path, header=True)


def append_results(results: DataFrame, path: str) -> None:
    """Long form (graph, method, t, metric, value)."""
    results.select("graph", "method", "t", "metric", "value").write.mode("append").partitionBy("metric").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Any comparison table as CSV; nulls are blank."""
    results.write.mode("overwrite").csv(path, header=True, nullValue="")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table by its stated schema; blank cells are null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="")
