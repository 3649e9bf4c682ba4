"""Notes as tables: Markdown folders, and notes derived from a documents table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of folders and files that are never notes.
IGNORED_PARTS = (".git", ".obsidian", ".trash", "node_modules", ".vscode", "__pycache__")
IGNORED_ENDINGS = (".baiduyun.uploading.cfg", ".tmp", ".temp", ".swp")
LAYERS = ("inbox", "distilled", "skills", "output")
AS_OF = "2024-05-01"


def ignored(path: Column) -> Column:
    """Whether a path lies in an ignored folder or is a temporary file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    ends = reduce(lambda a, b: a | b, (name.endswith(x) for x in IGNORED_ENDINGS))
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_PARTS))) | ends | name.startswith("~$")


def is_under(path: Column, root: str) -> Column:
    """Whether a path is a folder or lies in it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def relative(path: Column, vault: str) -> Column:
    """The path inside the vault; a path outside stays as it is."""
    head = vault.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substr(path, F.lit(len(head) + 1))).otherwise(path)


def layer_of(path: Column, roots: dict[str, str], system: tuple[str, ...] = ()) -> Column:
    """The layer whose root a path lies under: system folders first, then in the order of the layers, else "other"."""
    out = F.lit("other")
    for layer in reversed(LAYERS):
        if layer in roots:
            out = F.when(is_under(path, roots[layer]), layer).otherwise(out)
    for folder in system:
        out = F.when(is_under(path, folder), "system").otherwise(out)
    return out


def bucket_of(path: Column, layer: Column, vault: str, subfolders: dict[str, str], outside: str = "unmapped") -> Column:
    """The label of the first subfolder a path lies under; else its layer, and outside all layers its first folder."""
    out = F.when(layer == "other", F.concat(F.lit(outside + "/"), F.split_part(relative(path, vault), F.lit("/"), F.lit(1)))).otherwise(layer)
    for folder, label in reversed(subfolders.items()):
        out = F.when(is_under(path, folder), label).otherwise(out)
    return out


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, mtime, size, text) of all Markdown files below a folder; invalid UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return files.where(~ignored(F.col("path"))).select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


#: A table of up to so many bytes in fewer files than there are cores is dealt over them; a larger one in files of more than a part's bytes, into such parts.
SPREAD_BYTES, PART_BYTES = 1 << 28, 1 << 26


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one, whose files (often with one row group) would leave most cores without a task, is dealt
    over all cores, as work on texts is bound by them. A large one in a few large files, of which a row group or a text column may be
    one task's whatever its size, is dealt into parts of a bounded size; one in many files is split where it lies."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = len(df.inputFiles())
    if size <= SPREAD_BYTES:
        return df.repartition(cores) if files < cores else df
    return df.repartition(max(cores, -(-size // PART_BYTES))) if size > PART_BYTES * files else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A documents table as notes: (doc_id, name, path, bucket, layer, mtime, text)."""
    docs = table(spark, f"{sf_dir}/documents.parquet")
    layer = reduce(lambda c, kv: c.when(F.col("doc_id") % 4 == kv[0], kv[1]), enumerate(LAYERS[:3]), F).otherwise(LAYERS[3])
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc_"), "doc_id").alias("name"),
        F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"),
        F.col("source").alias("bucket"),
        layer.alias("layer"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 120 as int))").alias("mtime"),
        "text",
    )


#: Common words of the sample texts, stood for by words that the default rules look for.
MARKED = ((". ", "。"), (" the ", " 步骤 "), (" que ", "核心"), (" der ", "客户运营"), (" and ", "？"), (" was ", " 提示词 "), (" les ", "小红书"), (" los ", "已发布"), (" with ", "月入3万"), (" von ", "不是x而是"))


def marked(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), MARKED, text)


def marked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes() with texts that hold words of the default rules."""
    return notes(spark, sf_dir).withColumn("text", marked(F.col("text")))


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marked_notes() as Markdown: frontmatter, a heading and a bullet for each line."""
    n = marked_notes(spark, sf_dir)
    body = F.concat(F.lit("---\ndescription: "), F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")), F.lit("\n---\n# "), "name", F.lit("\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    return n.withColumn("text", body)


def clippings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pages table as clippings: (page_id, name, url, text)."""
    pages = table(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.concat(F.lit("page_"), "page_id").alias("name"), "url", F.col("html").alias("text"))
