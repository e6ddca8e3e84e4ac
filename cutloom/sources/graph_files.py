"""Project documents: JSON files that hold a graph as two id-keyed maps, in file versions 0 to 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CURRENT_VERSION = 2  # fixed value


def read_projects(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Raw documents (path, body): JSON projects, one per file or one per line."""
    return spark.read.text(path, wholetext=one_per_file).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def parse_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of documents (path, body).

    Version 0 is a bare graph, later versions wrap it in an envelope. Newer versions and text that is no project go to
    the reject frame with a reason instead of failing the job.
    """
    # explode of a one-element array parses a body once; the filters below would be pushed under a plain projection and parse it again
    x = docs.select("path", F.explode(F.array(F.try_parse_json("body"))).alias("v"))
    bare = F.try_variant_get("v", "$.nodes", "variant").isNotNull()
    version = F.when(bare, F.lit(0)).otherwise(F.try_variant_get("v", "$.fileVersion", "int"))
    graph = F.when(bare, F.col("v")).otherwise(F.try_variant_get("v", "$.graph", "variant"))
    x = x.withColumn("version", version).withColumn("g", graph)
    reason = (F.when(F.col("v").isNull(), "not-json").when(F.col("version").isNull(), "no-version")
              .when(F.col("version") > CURRENT_VERSION, "newer-version").when(F.col("version") < 0, "bad-version")
              .when(F.try_variant_get("g", "$.nodes", "variant").isNull(), "no-graph"))
    x = x.withColumn("reason", reason)
    good = x.where("reason is null").withColumn("project_id", F.try_variant_get("g", "$.projectId", "string"))

    def entries(field: str) -> DataFrame:
        part = good.select("path", "project_id", F.try_variant_get("g", f"$.{field}", "variant").alias("m"))
        return part.lateralJoin(part.sparkSession.tvf.variant_explode(F.col("m").outer())).select("path", "project_id", F.col("key"), F.col("value"))

    get = lambda f, t="string": F.try_variant_get("value", f"$.{f}", t)
    nodes = entries("nodes").select("path", "project_id", get("id").alias("id"), get("kind").alias("kind"), get("name").alias("name"),
                                    get("createdAt").alias("created_at"), get("updatedAt").alias("updated_at"), get("props", "variant").alias("props"))
    edges = entries("edges").select("path", "project_id", get("id").alias("id"), get("from").alias("src"), get("to").alias("dst"), get("type").alias("type"),
                                    get("props", "variant").alias("props"))
    return nodes, edges, x.where("reason is not null").select("path", "version", "reason")


def graph_documents(nodes: DataFrame, edges: DataFrame, per_document: int = 5000, project: str = "project") -> DataFrame:
    """Documents (path, body) of the current version with about ``per_document`` nodes and edges each.

    The number of documents follows the row counts, so no document grows with the graph. Edges that repeat fold to one
    edge whose props carry the number of copies.
    """
    folded = edges.groupBy("src", "dst", "type").agg(F.count("*").alias("copies"))
    buckets = max(1, -(-max(nodes.count(), folded.count()) // per_document))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    n = nodes.withColumn("bucket", bucket("id")).select("bucket", F.struct("id", "kind", "name").alias("n"))
    n = n.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n.id").alias("k"), F.col("n").alias("v")))).alias("nodes"))
    edge_id = F.concat_ws(">", "src", "dst", "type")
    e = folded.withColumn("bucket", bucket("src", "dst", "type")).select("bucket", F.struct(
        edge_id.alias("id"), F.col("src").alias("from"), F.col("dst").alias("to"), "type", F.struct("copies").alias("props")).alias("e"))
    e = e.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.id").alias("k"), F.col("e").alias("v")))).alias("edges"))
    graph = F.struct(F.lit(1).alias("version"), F.concat_ws("-", F.lit(project), "bucket").alias("projectId"), "nodes", "edges")
    body = F.to_json(F.struct(F.lit(CURRENT_VERSION).alias("fileVersion"), graph.alias("graph")))
    # a bucket without nodes (or edges) still is a project: empty maps instead of missing fields
    both = n.join(e, "bucket", "full")
    for c in ("nodes", "edges"):
        both = both.withColumn(c, F.coalesce(F.col(c), F.from_json(F.lit("{}"), both.schema[c].dataType)))
    return both.select(F.concat(F.lit("bucket="), F.col("bucket").cast("string")).alias("path"), body.alias("body"))


def write_projects(docs: DataFrame, path: str) -> None:
    """Documents one per line; JSON escapes line ends, so a body never holds one."""
    docs.select(F.col("body").alias("value")).write.mode("errorifexists").text(path)
