"""Readers and writers of text, chunk and question files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import indexed


def directory(spark: SparkSession, path: str, glob: str = "*.{txt,md,json}") -> DataFrame:
    """(path, content) of all files below *path* that match."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each line that isn't blank is a document, named by file and line.

    A file is read in blocks by many tasks; lines are numbered by their block and their order in it, so a file may be of any size.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    each = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    placed = indexed(each, ["path", "block", "row"], "place")
    begins = placed.groupBy("path").agg(F.min("place").alias("begin"))
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    held = placed.filter(F.btrim("line") != "").join(begins, "path")
    return held.select(F.format_string("%s_line_%05d", stem, F.col("place") - F.col("begin")).alias("doc_id"), F.btrim("line").alias("text"))


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first of several columns that exists and isn't blank."""
    held = [F.when(F.btrim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def chunk_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a file of records whose id and text go by several names, bare or in a wrapper.

    A record without text has that of its own chunks, joined by blank lines; one without id is named by its place. Records without either text are left out.
    """
    df = spark.read.option("multiLine", True).json(path)
    for wrapper in ("chunks", "documents", "docs", "data", "items"):
        kind = dict(df.dtypes).get(wrapper, "")
        if kind.startswith("array<struct") and not {"id", "doc_id", "docid"} & set(df.columns):
            df = df.select(F.posexplode_outer(wrapper).alias("_i", "r")).select("_i", "r.*")
            break
    else:
        df = indexed(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], "_i").drop("_row")
    text = first_of(df, ["text", "doc_text", "content", "chunk_text"])
    if dict(df.dtypes).get("chunks", "").startswith("array<struct"):
        names = [f.name for f in df.schema["chunks"].dataType.elementType.fields]
        own = lambda c: F.coalesce(*[F.when(c[n] != "", c[n].cast("string")) for n in ("chunk_text", "text", "content") if n in names], F.lit(None).cast("string"))
        parts = F.filter(F.transform("chunks", own), lambda t: t.isNotNull())
        text = F.coalesce(text, F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")))
    named = F.coalesce(first_of(df, ["id", "doc_id", "docid"]), F.format_string("chunk_%06d", "_i"))
    return df.select(named.alias("doc_id"), text.alias("text")).filter("text IS NOT NULL")


def clean_questions(spark: SparkSession, path: str, categories: tuple[str, ...] = ("questanswer_1doc", "questanswer_2docs", "questanswer_3docs")) -> DataFrame:
    """(category, id, question, answer) of a file with a list for each category; rows whose question or answer is blank are left out."""
    df = spark.read.option("multiLine", True).json(path)
    parts = []
    for c in categories:
        if not dict(df.dtypes).get(c, "").startswith("array<struct"):
            continue
        r = df.select(F.explode(c).alias("r")).select("r.*")
        parts.append(r.select(F.lit(c).alias("category"), *[(F.trim(F.col(n).cast("string")) if n in r.columns else F.lit(None).cast("string")).alias(a) for n, a in (("ID", "id"), ("questions", "question"), ("answers", "answer"))]))
    out = spark.createDataFrame([], "category string, id string, question string, answer string")
    for p in parts:
        out = out.unionByName(p)
    return out.filter("question <> '' AND answer <> ''")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of JSON lines whose fields go by several names; rows without a question are left out."""
    df = spark.read.json(path)
    q = first_of(df, ["question", "query", "instruction", "问题"])
    return df.select(q.alias("question"), first_of(df, ["answer", "reference_answer", "output", "答案"]).alias("answer")).filter("question IS NOT NULL")


def flatten(subfiles: DataFrame, chunk_id: Column | None = None) -> DataFrame:
    """(chunk_id, chunk_text, chunk_len, place) of rows (doc_id, chunks ARRAY<STRUCT<chunk_text, chunk_len>>).

    *chunk_id* is a column of doc_id and place; else the place has three digits at least.
    """
    each = subfiles.select("doc_id", F.posexplode("chunks").alias("place", "c"))
    if chunk_id is None:
        chunk_id = F.format_string("%s_sub_%03d", F.col("doc_id").cast("string"), "place")
    return each.select(chunk_id.alias("chunk_id"), "c.chunk_text", "c.chunk_len", "place")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One line of text for each chunk, white space collapsed; Spark's commit makes it appear whole."""
    chunks.select(F.btrim(F.regexp_replace("chunk", r"\s+", " ")).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to *path* has been committed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_chunk_files(chunks: DataFrame, path: str, name: str = "chunk_id", text: str = "chunk_text") -> bool:
    """Each chunk in a folder of its name, white space collapsed, blank ones left out; False, and nothing is done, if that was finished before.

    Spark's commit makes all of them appear at once, with its mark.
    """
    if finished(chunks.sparkSession, path):
        return False
    flat = chunks.select(F.col(name).alias("name"), F.btrim(F.regexp_replace(text, r"\s+", " ")).alias("value")).filter("value <> ''")
    flat.write.mode("overwrite").partitionBy("name").text(path)
    return True


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, chunk_text) of what write_chunk_files() wrote."""
    return spark.read.text(path).select(F.col("name").cast("string").alias("chunk_id"), F.col("value").alias("chunk_text"))
