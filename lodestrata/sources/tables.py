"""Readers: every scan is lazy, typed and pruned; files are found by Spark, so any store it knows works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = {"csv", "json", "parquet", "orc", "text"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or ValueError with the columns that are missing (names match whatever their case)."""
    have = {c.lower() for c in df.columns}
    missing = sorted(n for n in names if n.lower() not in have)
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_labelled_csv(spark: SparkSession, path: str, key: str, target: str, binary: bool) -> DataFrame:
    """A CSV with header; the target becomes a float. Rows whose target is no finite number (or, if binary, not 0 or 1) fail
    the scan when they are met, so the check costs no job of its own."""
    df = require_columns(spark.read.option("header", True).csv(path), key, target)
    value = F.col(target).try_cast("float")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    if binary:
        good &= value.isin(0.0, 1.0)
    return df.withColumn(target, F.when(F.assert_true(F.coalesce(good, F.lit(False)), F.concat(F.lit("bad target: "), F.coalesce(F.col(target), F.lit("null")))).isNull(), value))


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """The reader is named by the extension; only formats that hold no code are allowed."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "tsv":
        return spark.read.options(header=True, sep="\t", **options).csv(path)
    if kind not in FORMATS:
        raise ValueError(f"cannot read .{kind}; known: {sorted(FORMATS)}")
    return spark.read.options(**({"header": True} if kind == "csv" else {}), **options).format(kind).load(path)


def read_shards(spark: SparkSession, path: str, column: str, exclude: str | None = "val.parquet") -> DataFrame:
    """One column of a folder of Parquet shards, by any case of its name, without the excluded file."""
    df = require_columns(spark.read.parquet(path), column)
    if exclude:
        df = df.where(F.col("_metadata.file_name") != exclude)
    found = next(c for c in df.columns if c.lower() == column.lower())
    return df.select(F.col(found).alias(column))


def read_chunks(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The rows of Parquet shards with `file`, `row_in_file` and `chunk`: the number of their chunk of so many rows of the file.
    Row groups are read one after the other, so a task holds a batch and never a file; chunks of a file follow in order."""
    df = spark.read.parquet(path)
    at = F.col("_metadata.row_index")
    return df.select("*", F.col("_metadata.file_path").alias("file"), at.alias("row_in_file"), F.floor(at / rows).cast("long").alias("chunk"))


def shard_counts(df: DataFrame) -> DataFrame:
    """Rows and files of a Parquet scan; the count needs no column."""
    return df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_shards"))


def repaired_tsv(df: DataFrame, renames: dict[str, str], target: str, species: tuple[str, str] | None = None) -> DataFrame:
    """Exact duplicate rows go (or, instead, all rows of other species), columns are renamed, rows without target go."""
    df = df.where(F.col(species[0]) == species[1]) if species else df.dropDuplicates()
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns}).where(F.col(renames.get(target, target)).isNotNull())


def checked_ids(lines: DataFrame) -> DataFrame:
    """From a text scan (value, line): blank and repeated ids, with the first ten line numbers of each kind."""
    own = lines.select(F.col("line"), F.btrim(F.regexp_replace("value", "^﻿", "")).alias("id"))
    blank = own.where("id = ''").select(F.lit("blank").alias("problem"), "line")
    again = own.where("id <> ''").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where("n > 1").select(F.lit("duplicate").alias("problem"), "line")
    both = blank.unionAll(again)
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("problem").orderBy("line"))).where("r <= 10")
    return both.groupBy("problem").agg(F.count("*").alias("n")).join(first.groupBy("problem").agg(F.array_sort(F.collect_list("line")).alias("first_lines")), "problem")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: the lines of text files with what orders them. Files may be cut into splits: `block` is where a
    line's split begins in its file, and `line` rises within a split."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("line"), "value")


def conll(lines: DataFrame) -> DataFrame:
    """[file,] doc, sentence, place, token, tag, fields of every token line, from a scan (value, line [, file, block]).

    `-DOCSTART-` opens a document, a blank line ends a sentence; documents (in a file), sentences (in a document) and tokens (in a
    sentence) are numbered from 0, and those that hold no token do not count. Fields are cut at spaces: the first is the token, the
    last the tag. The scan is segmented: breaks are counted by running sums over parts of each file, so no task gets a whole file.
    """
    from ..operators.ordered import prefix_sums

    groups = ["file"] if "file" in lines.columns else []
    order = ["block", "line"] if "block" in lines.columns else ["line"]
    value = F.coalesce(F.rtrim("value"), F.lit(""))
    own = lines.withColumn("__start", value.startswith("-DOCSTART-").cast("long")).withColumn("__break", ((value == "") | (F.col("__start") == 1)).cast("long")).withColumn("__one", 1 - F.col("__break"))
    tokens = prefix_sums(own, groups, order, {"__d": "__start", "__s": "__break", "__t": "__one"}).where("__one = 1")
    heads = tokens.groupBy(*groups, "__d", "__s").agg(F.min("__t").alias("__first")).withColumn("__n", F.lit(1).cast("long"))
    sentences = prefix_sums(heads, [*groups, "__d"], ["__s"], {"sentence": "__n"}).drop("__n")
    docs = prefix_sums(heads.groupBy(*groups, "__d").agg(F.lit(1).cast("long").alias("__n")), groups, ["__d"], {"doc": "__n"}).drop("__n")
    fields = F.split(F.rtrim("value"), " ")
    rows = tokens.join(sentences, [*groups, "__d", "__s"]).join(docs, [*groups, "__d"])
    return rows.select(*groups, "doc", "sentence", (F.col("__t") - F.col("__first")).alias("place"), fields[0].alias("token"), F.element_at(fields, -1).alias("tag"), fields.alias("fields"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """`conll` over the files under path."""
    return conll(file_lines(spark, path))


def scrape(lines: DataFrame) -> DataFrame:
    """Progress marks `done/total [` in log lines, one row a mark."""
    marks = F.regexp_extract_all("value", F.lit(r"(\d+/\d+)\s+\["), 1)
    at = F.split("mark", "/")
    return lines.select(F.explode(marks).alias("mark")).select(at[0].cast("long").alias("done"), at[1].cast("long").alias("total"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, n_bytes, sha256 of every file under path: a manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
