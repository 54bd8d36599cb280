"""Readers. Every source is a DataFrame; pruning and pushdown are left to Spark."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters tried, and lines sampled, when sniffing a CSV file.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 20


def load_table(spark: SparkSession, name: str, path: str | None = None) -> DataFrame | None:
    """A catalog table, or a parquet folder ``path/name`` (with or without suffix); None when absent."""
    if path is None:
        return spark.table(name) if spark.catalog.tableExists(name) else None
    for candidate in (f"{path}/{name}", f"{path}/{name}.parquet"):
        if _exists(spark, candidate):
            return spark.read.parquet(candidate)
    return None


def load_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A database table; with a numeric column and its bounds the read is split."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first lines most evenly."""
    lines = [r["value"] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]

    def merit(d: str) -> tuple[int, int]:
        counts = Counter(line.count(d) for line in lines)
        columns, agreeing = max(((c, n) for c, n in counts.items() if c > 0), key=lambda x: (x[1], x[0]), default=(0, 0))
        return agreeing, columns

    return max(DELIMITERS, key=merit)


def load_csv(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; the delimiter is found if not given, bad lines are dropped, names are trimmed.

    Without a schema all columns are strings: cast them where they are used.
    """
    reader = spark.read.option("header", True).option("sep", sep or sniff_delimiter(spark, path)).option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def load_source(spark: SparkSession, name: str, fmt: str, location: str) -> DataFrame:
    """Reader by format: ``table``, ``parquet``, ``orc``, ``json``, ``csv`` or ``jdbc``."""
    if fmt == "table":
        return spark.table(name)
    if fmt == "csv":
        return load_csv(spark, f"{location}/{name}.csv")
    if fmt == "jdbc":
        return load_jdbc(spark, location, name)
    if fmt in ("parquet", "orc", "json"):
        return spark.read.format(fmt).load(f"{location}/{name}")
    raise ValueError(f"unknown source format {fmt}")


def read_interactions(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Interaction lines ``u,i,ts,label,f1..fn`` with any number of features.

    With ``header`` the first line of each file is left out, whatever it says. ``idx`` is the line order (0-based, header excluded).
    """
    from biparta.operators.ordering import running_sum

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # one column per line: no text holds the separator, and the reader knows where files begin
    whole = spark.read.schema("value string").options(sep="\x01", quote="", header=header, enforceSchema=True).csv(path)
    lines = whole.select("value", *place, F.monotonically_increasing_id().alias("line"))
    data = lines.filter(F.length(F.trim("value")) > 0).withColumn("one", F.lit(1))
    numbered = running_sum(data, [F.col("file").asc(), F.col("block").asc(), F.col("line").asc()], {"n": "one"})
    p = F.split("value", ",")
    feats = F.transform(F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0))), lambda x: x.cast("double"))
    return numbered.select(
        p[0].cast("bigint").alias("u"),
        p[1].cast("bigint").alias("i"),
        p[2].cast("double").alias("ts"),
        p[3].cast("double").alias("label"),
        (F.col("n") - 1).cast("bigint").alias("idx"),
        feats.alias("feats"),
    )


def load_edge_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Interactions (features on the row) and, if written, node features."""
    nodes = f"{path}/node_features"
    return spark.read.parquet(f"{path}/interactions"), spark.read.parquet(nodes) if _exists(spark, nodes) else None


def load_id_map(spark: SparkSession, path: str, side: str) -> DataFrame:
    """``(side, id, name)`` from parquet, else from a CSV with an id and a name column in either order."""
    parquet = f"{path}/{side}_map"
    if _exists(spark, parquet):
        df = spark.read.parquet(parquet)
    else:
        df = load_csv(spark, f"{path}/{side}_map.csv")
    id_col = next(c for c in df.columns if "id" in c.lower())
    name_col = next(c for c in df.columns if "name" in c.lower())
    return df.select(F.lit(side).alias("side"), F.col(id_col).cast("bigint").alias("id"), F.col(name_col).alias("name"))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved graph."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run results, one JSON document per file; ``run`` is the loss name or the file stem."""
    df = spark.read.option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    name = F.coalesce(F.col("loss_function"), stem) if "loss_function" in df.columns else stem
    return df.withColumn("run", name)


def scan_metric_logs(spark: SparkSession, path: str, patterns: dict[str, str], name: str = r"([^/]+)$") -> DataFrame:
    """One row per log with the last value each pattern (one group) captured; null when absent.

    ``name`` takes the run's name from the file path.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), name, 1).alias("run"), place.alias("line"), "value")
    found: list[Column] = []
    for metric, pattern in patterns.items():
        value = F.regexp_extract("value", pattern, 1).try_cast("double")
        found.append(F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col("line"))).alias(metric))
    return lines.groupBy("run").agg(*found)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
