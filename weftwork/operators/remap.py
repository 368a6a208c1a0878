"""Record remaps: common conversation layouts to an array of turns, in addition to the fields that are there.

Records are JSON text.  The turns are built by expressions over a variant of the record; only writing them into open
JSON at a path is done in Arrow batches, since the other keys and their order must stay as they are.  The first bad
record in order raises, with its number from 1.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import js, paths, text


class InputDatasetRemapError(ValueError):
    pass


TURNS = "array<struct<role:string,content:string>>"


def prefixed_turns(v: Column, config: dict) -> tuple[Column, Column]:
    """(turns, error) of a ``prefixed_string_array`` remap over a variant record."""
    path, p = config["sourcePath"], config["prefixes"]
    source = paths.items(paths.at(v, path))
    pairs = [(role, p[role]) for role in ("user", "assistant", "system") if p.get(role)]

    def content(c: Column) -> Column:
        return text.trim(c) if config.get("trimContent", True) else c

    def turn(x: Column) -> Column:
        s = text.trim_start(paths.string(x))
        out = F
        for role, prefix in pairs:
            out = out.when(F.startswith(s, F.lit(prefix)), F.struct(F.lit(role).alias("role"), content(F.substring(s, F.lit(len(prefix) + 1), F.length(s))).alias("content")))
        return out

    turns = F.transform(source, turn)
    whole = F.transform(source, lambda x: paths.string(x).isNull())
    bad_item = F.array_position(whole, True)
    bad_prefix = F.array_position(F.transform(turns, lambda t: t.isNull()), True)
    spot = F.when(bad_item > 0, F.when(bad_prefix < bad_item, bad_prefix).otherwise(bad_item)).otherwise(bad_prefix)
    error = (
        F.when(paths.kind(v) != "object", " is not an object")
        .when(paths.at(v, path).isNull(), f" path '{path}' could not be resolved")
        .when(source.isNull(), f" path '{path}' must resolve to an array")
        .when((bad_item > 0) & (bad_item == spot), F.concat(F.lit(" conversation item "), (spot - 1).cast("string"), F.lit(" is not a string")))
        .when(spot > 0, F.concat(F.lit(" conversation item "), (spot - 1).cast("string"), F.lit(" does not match any configured prefix")))
    )
    return turns, error


def alpaca_turns(v: Column, config: dict) -> tuple[Column, Column]:
    """(turns, error) of an ``alpaca`` remap: instruction, input that may be missing, output."""
    names = [config.get(f"{k}Field", k) for k in ("instruction", "input", "output")]
    instruction, given, output = (paths.at(v, n) for n in names)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), paths.string(c).alias("content"))
    has_input = text.trim(F.coalesce(paths.string(given), F.lit(""))) != ""
    turns = F.when(has_input, F.array(turn("system", instruction), turn("user", given), turn("assistant", output))).otherwise(F.array(turn("user", instruction), turn("assistant", output)))

    def required(c: Column, name: str) -> list[tuple[Column, str]]:
        return [(c.isNull(), f" is missing required Alpaca field '{name}'"), (paths.string(c).isNull(), f" field '{name}' must be a string"), (text.trim(paths.string(c)) == "", f" field '{name}' must not be empty")]

    error = F.when(paths.kind(v) != "object", " is not an object")
    for bad, say in [*required(instruction, names[0]), *required(output, names[2]), (given.isNotNull() & paths.string(given).isNull(), f" field '{names[1]}' must be a string")]:
        error = error.when(bad, say)
    return turns, error


def turns_of(v: Column, config: dict) -> tuple[Column, Column]:
    return (prefixed_turns if config["kind"] == "prefixed_string_array" else alpaca_turns)(v, config)


def remap(records: DataFrame, config: dict) -> DataFrame:
    """``records`` (_ord, _json) with the turns set at the output path.  Raises for the first record that cannot be."""
    v = paths.parse(F.col("_json"))
    turns, error = turns_of(v, config)
    role, content = config.get("roleField", "from"), config.get("contentField", "value")
    path = config.get("outputPath", "conversations")

    @F.pandas_udf("struct<json:string,error:string>")
    def put(raw: pd.Series, to: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t in zip(raw, to, strict=True):
            if t is None:
                rows.append((None, None))
                continue
            try:
                new = [{role: x["role"], content: x["content"]} for x in json.loads(t)]
                rows.append((js.to_json(js.set_path(json.loads(r), path, new, create=True)), None))
            except js.PathError as e:
                rows.append((None, f" {e}"))
        return pd.DataFrame(rows, columns=["json", "error"])

    out = records.select("_ord", "_json", error.alias("_error"), F.to_json(turns).alias("_turns")).withColumn("_new", put("_json", F.when(F.col("_error").isNull(), F.col("_turns"))))
    out = out.select("_ord", F.coalesce("_error", "_new.error").alias("_error"), F.col("_new.json").alias("_json"))
    first = out.where("_error is not null").agg(F.min(F.struct("_ord", "_error")).alias("e")).first().e
    if first:
        raise InputDatasetRemapError(f"Record {first._ord + 1}{first._error}")
    return out.select("_ord", "_json")
