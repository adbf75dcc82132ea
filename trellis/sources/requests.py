"""Requests of a batch, read from a JSON array or JSON lines, and the documents that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workdir

REQUEST = "struct<id:string,command:string,symbol:string>"
#: What stands for a field that is missing or null.
DEFAULTS = {"id": "request", "command": "", "symbol": ""}


def read_requests(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """position (from 1), id, command, symbol of every request of one file.

    form: json, one array of objects; jsonl, an object a line, blank lines
    skipped. Text that is neither raises. A request without an id is called
    `request`; other fields are ignored.
    """
    whole = spark.read.text(path, wholetext=True)
    if form == "json":
        array = F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$")
        parsed = F.from_json("value", f"array<{REQUEST}>", {"mode": "FAILFAST"})
        found = whole.select(F.when(array, parsed).otherwise(F.raise_error(F.lit("batch json input must be an array")).cast(f"array<{REQUEST}>")).alias("r"))
        rows = found.select(F.posexplode("r").alias("i", "r"))
    elif form == "jsonl":
        lines = whole.select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines")).select(F.posexplode("lines").alias("i", "line"))
        rows = lines.select("i", F.from_json("line", REQUEST.removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "FAILFAST"}).alias("r"))
    else:
        raise ValueError(f"unknown form: {form}")
    return rows.select((F.col("i") + 1).alias("position"), *[F.coalesce(F.col(f"r.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def responses(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """position, json: one document a request, of the rows that lookup.batch gives it, in the order of the requests.

    A request's matches stand together in its document, as the answer to it;
    a request that matches nothing has an empty list.
    """
    match = F.struct("file_path", "line", "column", "symbol", "why_matched", "confidence", "score")
    rank = F.struct((-F.col("score")).alias("s"), "file_path", "line", "column", "symbol")
    listed = answers.where("error is null").groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), match.alias("match")))), lambda x: x["match"]).alias("results"))
    listed = workdir.stage(listed, "responses")
    empty = F.array().cast(listed.schema["results"].dataType)
    errors = answers.where("error is not null").select("position", "error")
    rows = requests.join(listed, "position", "left").join(errors, "position", "left")
    good = F.to_json(F.struct("id", F.lit(True).alias("ok"), "command", F.struct(F.col("symbol").alias("query"), F.coalesce("results", empty).alias("results")).alias("data")))
    bad = F.to_json(F.struct("id", F.lit(False).alias("ok"), F.struct(F.lit("UNSUPPORTED_BATCH_COMMAND").alias("code"), F.col("error").alias("message")).alias("error")))
    return rows.select("position", F.when(F.col("error").isNull(), good).otherwise(bad).alias("json")).orderBy("position")
