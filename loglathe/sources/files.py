"""Scans and sinks of files: JSON lines, digests of trees, content-addressed artifacts, run directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X

PART = "struct<type:string,text:string,id:string,name:string,arguments:string>"
USAGE = "struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint,totalTokens:bigint,cost:struct<total:double>>"
MESSAGE = f"struct<role:string,content:string,stopReason:string,toolCallId:string,toolName:string,isError:boolean,provider:string,model:string,errorMessage:string,timestamp:bigint,usage:{USAGE}>"
#: A session's log, one entry a line; content stays JSON, as it is a string or a list of parts.
ENTRY = f"id string, parentId string, type string, timestamp string, message {MESSAGE}, customType string, data string, summary string, fromId string, tokensBefore bigint"

#: Kinds of tools whose results are projected, and bytes from which.
PROJECTED = {"bash": ("tail", 16_384), "read": ("head", 16_384), "agent": ("head", 24_576)}
MCP_BYTES = 16_384


# ---------------------------------------------------------------------- scans
def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines: a bad line fails the scan, or is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: lines that are no JSON value.

    Files are read by lines and blocks; a window numbers a file's lines.
    """
    from pyspark.sql.window import Window as W

    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    by = W.partitionBy("file_path").orderBy("file_block_start", "i")
    wrong = (F.col("value") != "") & F.try_parse_json("value").isNull()
    lines = text.select(F.col("file_path").alias("file"), wrong.alias("wrong"), F.row_number().over(by).alias("line"))
    return lines.where("wrong").select("file", "line")


def json_keys(text: Column) -> Column:
    return F.array_sort(F.json_object_keys(text))


def exact_record(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(json_keys(text) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def keys_within(text: Column, required: list[str], optional: list[str]) -> Column:
    keys = json_keys(text)
    lit = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    return F.coalesce((F.size(F.array_except(lit(required), keys)) == 0) & (F.size(F.array_except(keys, lit(required + optional))) == 0), F.lit(False))


def content_text(content: Column) -> Column:
    """A content's text: itself, or its text parts, one a line."""
    parts = F.from_json(content, f"array<{PART}>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.when(content.startswith("["), joined).otherwise(F.coalesce(content, F.lit("")))


def tool_calls(entries: DataFrame) -> DataFrame:
    """entry, pos, call_id, name, arguments of all calls in assistants' entries."""
    parts = F.from_json("message.content", f"array<{PART}>")
    calls = F.filter(parts, lambda p: p["type"] == "toolCall")
    return entries.where("message.role = 'assistant'").select(F.col("id").alias("entry"), F.posexplode(calls).alias("pos", "c")).select("entry", "pos", F.col("c.id").alias("call_id"), "c.name", "c.arguments")


def entry_messages(entries: DataFrame) -> DataFrame:
    """The message of each entry that has one: compactions and summaries of branches become messages of their own roles."""
    role = F.when(F.col("type") == "compaction", "compactionSummary").when((F.col("type") == "branch_summary") & (F.length("summary") > 0), "branchSummary").when(F.col("type") == "custom_message", "custom").when(F.col("type") == "message", F.col("message.role"))
    content = F.when(F.col("type").isin("compaction", "branch_summary"), F.col("summary")).otherwise(F.coalesce("message.content", F.lit("[]")))
    return entries.select(F.col("id").alias("entry"), F.col("parentId").alias("parent"), F.nullif(role, F.lit("")).alias("role"), content.alias("content"), F.col("message.stopReason").alias("stop_reason"), F.col("message.usage").alias("usage")).where("role is not null")


def provider_tokens(usage: Column) -> Column:
    parts = [F.coalesce(usage[c], F.lit(0)) for c in ("input", "output", "cacheRead", "cacheWrite")]
    return F.coalesce(usage["totalTokens"], parts[0] + parts[1] + parts[2] + parts[3])


# ---------------------------------------------------------------------- sinks
def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def write_exclusive(df: DataFrame, path: str) -> None:
    """Fails where something is there."""
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)


def write_atomic(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


# -------------------------------------------------------------------- digests
def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path below the root, bytes and digest of each file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    return f.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))


def tree_digest(spark: SparkSession, root: str) -> DataFrame:
    """One digest of a directory's sorted paths and digests."""
    f = files(spark, root)
    manifest = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat_ws(" ", x["path"], x["sha"]))
    return f.groupBy().agg(F.sha2(F.array_join(manifest, "\n"), 256).alias("sha"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def expected_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences of two lists (path, sha): missing, extra, changed."""
    j = expected.select("path", F.col("sha").alias("a")).join(actual.select("path", F.col("sha").alias("b")), "path", "full")
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", what.alias("what")).where("what is not null")


# ------------------------------------------------------------------ artifacts
def store_artifacts(df: DataFrame, root: str) -> DataFrame:
    """Write content (binary, with owner) once for each digest, partitioned by its first two digits; returns the descriptors."""
    r = df.select("owner", "content", F.sha2("content", 256).alias("sha"))
    r.dropDuplicates(["sha"]).select("sha", "content", F.left("sha", F.lit(2)).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(root)
    return r.select("owner", "sha", F.length("content").cast("bigint").alias("bytes"), F.concat(F.lit("sha256/"), F.left("sha", F.lit(2)), F.lit("/"), F.col("sha")).alias("path"))


def verify_artifacts(spark: SparkSession, descriptors: DataFrame, root: str) -> DataFrame:
    """Descriptors whose artifact is missing or differs in size or digest."""
    a = spark.read.parquet(root).select(F.col("sha").alias("named"), F.sha2("content", 256).alias("found"), F.length("content").cast("bigint").alias("size"))
    j = descriptors.join(a, descriptors.sha == a.named, "left")
    return j.where("found is null or found <> sha or size <> bytes").select("owner", "sha", F.when(F.col("found").isNull(), "missing").otherwise("differs").alias("what"))


def project_results(r: DataFrame) -> DataFrame:
    """Tool results (tool, text) beyond their tool's size: a head or a tail, and a line that names the artifact."""
    size = F.octet_length("text")
    kinds = F.lower("tool")
    limit = F.coalesce(*(F.when(kinds == k, F.lit(n)) for k, (_, n) in PROJECTED.items()), F.when(F.col("tool").rlike(X.MCP_TOOL), F.lit(MCP_BYTES)))
    tail = F.coalesce(*(F.when(kinds == k, F.lit(way == "tail")) for k, (way, _) in PROJECTED.items()), F.lit(False))
    line = F.concat(F.lit("[full result: sha256/"), F.sha2("text", 256), F.lit(", "), size.cast("string"), F.lit(" bytes]"))
    room = F.greatest(limit - F.octet_length(line) - 1, F.lit(0))
    cut = F.when(tail, F.concat_ws("\n", line, X.utf8_tail(F.col("text"), room))).otherwise(F.concat_ws("\n", X.utf8_head(F.col("text"), room), line))
    over = size > limit
    return r.withColumn("projected", F.when(over, cut).otherwise(F.col("text"))).withColumn("server", X.mcp_server(F.col("tool"), "local")).withColumn("cut", F.coalesce(over, F.lit(False)))


# ------------------------------------------------------------------- run dirs
def newest_evidence(f: DataFrame) -> DataFrame:
    """Of each run's files (run, name) the one that counts: the newest sidecar, else the base file."""
    sidecar = F.col("name").rlike(r"^evidence\..+\.json$")
    r = f.where(sidecar | (F.col("name") == "evidence.json")).withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy(sidecar.desc(), F.desc("name"))))
    return r.where("rank = 1").select("run", "name")
