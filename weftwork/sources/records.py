"""Datasets of JSON records: scans of JSON arrays and JSON lines, slices, and the JSON lines sink.

A record DataFrame is (_ord long, _json string): a dense number in input order, and the record's text as it was.
Ordinals of a file come from counts per split and their running sum, so no task sees all rows.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions import js, text
from weftwork.operators.remap import remap as remap_records
from weftwork.sources.scratch import written


class InputDatasetValidationError(ValueError):
    pass


class InputDatasetParseError(ValueError):
    pass


def infer_format(path: str) -> str:
    low = path.lower()
    if low.endswith(".jsonl"):
        return "jsonl"
    if low.endswith(".json"):
        return "json"
    raise InputDatasetValidationError(f"Could not infer input format from path: {path}")


@F.pandas_udf(T.BooleanType())
def is_json(raw: pd.Series) -> pd.Series:
    """Whether a text is exactly one strict JSON value."""

    def one(x: str) -> bool:
        try:
            js.parse_json(js.trim(x))
            return True
        except (ValueError, RecursionError):
            return False

    return raw.map(one)


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _dense(marked: DataFrame) -> DataFrame:
    """Places in splits to places overall: the splits' running counts (one row a split) are joined, not put into the plan."""
    counts = marked.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    ends = list(itertools.accumulate(r.n for r in counts))
    bases = marked.sparkSession.createDataFrame([(r["_part"], end - r.n) for r, end in zip(counts, ends, strict=True)], "_part int, _base long")
    return marked.join(F.broadcast(bases), "_part").withColumn("_ord", F.col("_base") + F.col("_at")).drop("_at", "_part", "_base")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` of a file scan with ``_ord``: dense numbers in the order of file position, from two passes over the
    splits.  Only for plans without a shuffle, whose splits are the same in both passes."""
    return _dense(_marked(lines))


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``_ord`` in the order of ``by``: dealt by range, written with its place, then numbered.  Written,
    because the ranges are sampled and would differ in a second pass."""
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return _dense(written(_marked(df.repartitionByRange(n, *by).sortWithinPartitions(*by)), "ordered"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file whose whole text is one top-level array."""
    whole = [r.value for r in spark.read.text(path, wholetext=True).collect()]  # one value by definition of the format
    try:
        value = js.parse_json("".join(whole))
    except ValueError as e:
        raise InputDatasetParseError(f"Failed to parse JSON input file: {path}") from e
    if not isinstance(value, list):
        raise InputDatasetValidationError(f"JSON input file must contain a top-level array: {path}")
    return records_of(spark, value)


def records_of(spark: SparkSession, values: list[Any]) -> DataFrame:
    return spark.createDataFrame([(i, js.to_json(v)) for i, v in enumerate(values)], "_ord long, _json string")


def values_of(records: DataFrame) -> list[Any]:
    """The records as values, in order: for stages that need all of them in one prompt."""
    return [json.loads(r["_json"]) for r in records.orderBy("_ord").collect()]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return numbered(raw).select(F.col("_ord").alias("_line"), text.trim(F.col("value")).alias("_json"))


def read_jsonl(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """JSON lines, blanks skipped.  Lines beyond the slice are never parsed; a bad one in it raises with its number."""
    lines = _lines(spark, path)
    full = lines.where("_json <> ''")
    dense = slice_records(numbered(full), offset, limit)
    bad = dense.where(~is_json("_json")).agg(F.min("_line")).first()[0]
    if bad is not None:
        raise InputDatasetParseError(f"Failed to parse JSONL input file {path} at line {bad + 1}")
    return dense.select("_ord", "_json")


def slice_records(records: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records offset .. offset + limit by ``_ord``, numbered from 0 again."""
    out = records.where(F.col("_ord") >= offset) if offset else records
    if limit is not None:
        out = out.where(F.col("_ord") < offset + limit)
    return out.withColumn("_ord", F.col("_ord") - offset) if offset else out


def load_records(spark: SparkSession, config: dict) -> DataFrame:
    """format, slice, then remap."""
    kind = config.get("format") or infer_format(config["path"])
    offset, limit = config.get("offset", 0), config.get("limit")
    if kind == "jsonl":
        records = read_jsonl(spark, config["path"], offset, limit)
    else:
        if config.get("readMode") == "stream":
            raise InputDatasetValidationError(f"readMode=stream is currently only supported for jsonl input: {config['path']}")
        records = slice_records(read_json_array(spark, config["path"]), offset, limit)
    return remap_records(records, config["remap"]) if config.get("remap") else records


def write_jsonl(records: DataFrame, folder: str) -> None:
    """JSON lines as a folder of files in order (sorted by range, so no single task has all)."""
    records.repartitionByRange("_ord").sortWithinPartitions("_ord").select(F.col("_json").alias("value")).write.mode("overwrite").text(folder)


def to_jsonl(value: Any) -> str:
    """A list as a line for each element, anything else as one line; an absent value as nothing."""
    if value is js.MISSING:
        return ""
    return "".join(js.to_json(v) + "\n" for v in value) if isinstance(value, list) else js.to_json(value) + "\n"


def turns_table(conversations: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row of turns (role, text) for each conversation, in order."""
    turns = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return conversations.groupBy(key).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def arrow_map(records: DataFrame, each: Any, column: str = "_json") -> DataFrame:
    """``each(json text) -> json text`` over the records, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([each(x) for x in b.column(1).to_pylist()], pa.string())], names=["_ord", column])

    return records.select("_ord", "_json").mapInArrow(run, f"_ord long, {column} string")


def unique_name() -> str:
    return uuid.uuid4().hex
