"""Reading archives: rollout files and their lines, index tables, related records, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..functions.expr import content_id


def read_rollout_files(spark: SparkSession, root: str, inventory: DataFrame | None = None, glob: str = "rollout-*.jsonl") -> DataFrame:
    """path below root, byte_length, mtime, archived of every file whose name fits glob.

    The file scan leaves out empty files; an inventory (path, byte_length, mtime) adds them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select(F.regexp_extract("path", r"((?:archived_)?sessions/.*)$", 1).alias("path"), F.col("length").alias("byte_length"), F.col("modificationTime").alias("mtime"))
    if inventory is not None:
        rows = rows.unionByName(inventory.filter("byte_length = 0").select("path", "byte_length", "mtime"))
    return rows.withColumn("archived", F.col("path").startswith("archived_sessions/"))


def read_rollout_lines(spark: SparkSession, root: str) -> DataFrame:
    """file, line_no, raw (binary), ending of every line, byte by byte; for files that fit a row (see read_large_lines)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl").load(root)
    return split_lines(files.select(F.regexp_extract("path", r"((?:archived_)?sessions/.*)$", 1).alias("file"), "content"))


def read_large_lines(spark: SparkSession, root: str) -> DataFrame:
    """read_rollout_lines for files of any size: each is read in splits, by many tasks.

    Lines are numbered inside a split and the splits' counts added up. The reader does not tell
    whether the last line ends with a line end; the file's size does.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl").text(root)
    path = F.regexp_extract("_metadata.file_path", r"((?:archived_)?sessions/.*)$", 1)
    rows = text.select(path.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("lines"), F.sum("bytes").over(whole).alias("bytes"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place")) - 1
    rows = rows.withColumn("r", inside).join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("line_no", (F.col("before") + F.col("r")).cast("long"))
    open_end = (F.col("line_no") == F.col("lines") - 1) & (F.col("bytes") > F.col("size"))
    cr = F.expr("right(hex(line), 2) = '0D'")
    ending = F.when(open_end, "").when(cr, "\r\n").otherwise("\n")
    raw = F.when(~open_end & cr, F.expr("substring(line, 1, octet_length(line) - 1)")).otherwise(F.col("line"))
    return rows.select("file", "line_no", ending.alias("ending"), raw.alias("raw"))


def split_lines(files: DataFrame) -> DataFrame:
    """Lines of `content`, endings (CR LF, LF or none) apart; bytes pass through a one-byte encoding unchanged."""
    text = F.decode("content", "ISO-8859-1")
    rows = files.select(*(c for c in files.columns if c != "content"), F.posexplode(F.split(text, r"(?<=\n)")).alias("line_no", "line")).filter("line <> ''")
    ending = F.when(F.col("line").endswith("\r\n"), "\r\n").when(F.col("line").endswith("\n"), "\n").otherwise("")
    body = F.substr("line", F.lit(1), F.length("line") - F.length(ending))
    return rows.withColumn("ending", ending).withColumn("raw", F.encode(body, "ISO-8859-1")).withColumn("line_no", F.col("line_no").cast("long")).drop("line")


def read_thread_index(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of index tables, first source first, one row per id; and warnings for sources without ids.

    Ids are texts: of a source whose ids are of another type no row is taken, as of rows with a null id.
    """
    union, warnings = None, []
    for priority, (name, df) in enumerate(sources.items()):
        if "id" not in df.columns:
            warnings.append(name)
            continue
        text = df.schema["id"].dataType.typeName() == "string"
        one = df.filter("id IS NOT NULL" if text else "false").withColumn("id", F.col("id").cast("string")).withColumn("source", F.lit(name)).withColumn("priority", F.lit(priority))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    spark = next(iter(sources.values())).sparkSession
    warned = spark.createDataFrame([("database_schema_unsupported", n) for n in warnings], "kind string, source string")
    if union is None:
        return spark.createDataFrame([], "id string, source string, priority int"), warned
    first = F.row_number().over(Window.partitionBy("id").orderBy("priority"))
    return union.withColumn("rn", first).filter("rn = 1").drop("rn"), warned


def rows_to_json(df: DataFrame) -> Column:
    """Any row as a JSON object: nulls kept, bytes tagged and in base64."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f.name)
        fields.append(F.struct(F.lit("blob").alias("$type"), F.base64(c).alias("base64")).alias(f.name) if isinstance(f.dataType, BinaryType) else c)
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_to_typed(text: Column, schema: StructType) -> list[Column]:
    """The columns of a schema out of a JSON object; booleans as 0 and 1 for numbers, tagged bytes decoded, else null.

    The last column, `problems`, lists the fields whose value is there but does not fit its type.
    """
    v = F.try_parse_json(text)
    out, problems = [], []
    for f in schema.fields:
        path, kind = f"$.{f.name}", f.dataType.simpleString()
        if isinstance(f.dataType, BinaryType):
            value = F.unbase64(F.try_variant_get(v, f"{path}.base64", "string"))
        elif kind in ("int", "bigint"):
            value = F.coalesce(F.try_variant_get(v, path, kind), F.try_variant_get(v, path, "boolean").cast(kind))
        else:
            value = F.try_variant_get(v, path, kind)
        out.append(value.alias(f.name))
        there = F.try_variant_get(v, path, "string").isNotNull()
        problems.append(F.when(value.isNull() & there, F.lit(f.name)))
    return [*out, F.array_compact(F.array(*problems)).alias("problems")]


def collect_related(children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """thread_id, table_name, place, row (JSON) of all child tables; each comes with its foreign-key column.

    A row per related row, numbered from 0 in the order of its text, so a thread may have any number of them.
    """
    union = None
    for name, (df, fk) in children.items():
        one = df.select(F.col(fk).alias("thread_id"), F.lit(name).alias("table_name"), rows_to_json(df).alias("row"))
        union = one if union is None else union.unionByName(one)
    return union.withColumn("place", F.row_number().over(Window.partitionBy("thread_id", "table_name").orderBy("row")) - 1)


def unchanged_files(files: DataFrame, cache: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """files with `content_id` where the cached reference still holds, else null: those must be read again.

    A reference holds if length, mtime and thread are the same and all its chunks are stored.
    cache: path, byte_length, mtime, thread_id, content_id; chunks: content_id, sha256.
    """
    gone = chunks.join(objects.select("sha256"), "sha256", "left_anti").select("content_id").distinct()
    whole = cache.join(gone, "content_id", "left_anti")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("path", "byte_length", "mtime", "thread_id")]
    return files.alias("f").join(whole.alias("c"), same[0] & same[1] & same[2] & same[3], "left").select("f.*", "c.content_id")


def refreshed_contents(files: DataFrame, read_again: DataFrame) -> DataFrame:
    """The files of unchanged_files with the content ids of those that had to be read again (path, content_id); a file without either keeps null."""
    new = read_again.select(F.col("path"), F.col("content_id").alias("__new"))
    rows = files.join(new, "path", "left")
    return rows.withColumn("reused", F.col("content_id").isNotNull()).withColumn("content_id", F.coalesce("content_id", "__new")).drop("__new")


def publish_snapshot(threads: DataFrame, snapshot_id: str, path: str) -> None:
    """Write descriptors, overlay and references of a snapshot under its id; one that exists is never overwritten.

    threads: thread_id, title, archived, content_id, observed_provider, local_path.
    """
    described = threads.withColumn("descriptor", content_id(F.to_json(F.struct("thread_id", "title", "archived", "content_id"), {"ignoreNullFields": "false"})))
    parts = {
        "descriptors": described.select("descriptor", "thread_id", "title", "archived", "content_id").dropDuplicates(["descriptor"]),
        "overlays": described.select("thread_id", "observed_provider", "local_path"),
        "snapshot_threads": described.select("thread_id", "descriptor"),
    }
    for name, df in parts.items():
        df.write.mode("error").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")


def load_snapshot(spark: SparkSession, snapshot_id: str, path: str) -> DataFrame:
    """Full threads again: references, descriptors and, where there is one, the overlay."""
    read = lambda n: spark.read.parquet(f"{path}/{n}/snapshot_id={snapshot_id}")
    refs = read("snapshot_threads").join(read("descriptors").drop("thread_id"), "descriptor")
    return refs.join(read("overlays"), "thread_id", "left")
