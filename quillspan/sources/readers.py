"""Sources: Markdown folders, record and bibliography files, with gates that refuse a document, not the run."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.blocks import SCHEMA

RECORDS_SCHEMA = "quillspan-records-1"


def markdown_files(spark: SparkSession, paths: Sequence[str], glob: str = "*.md") -> DataFrame:
    """(doc_id, path, content) of files, each once; folders are walked, and what lies in .git is left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    return raw.where(~F.col("path").rlike("/\\.git/")).dropDuplicates(["path"]).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def gate_encoding(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as text, refused with byte offset and reason). Valid files, which most are, never leave the JVM."""
    fine = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content"), F.lit(b"\0"))
    ok = files.where(fine).select("doc_id", "path", F.decode("content", "UTF-8").alias("text"))
    return ok, files.where(~fine).select("doc_id", "path", "content").mapInArrow(_refuse, "doc_id bigint, path string, offset bigint, reason string")


def refusal(raw: bytes) -> tuple[int, str] | None:
    """(offset, reason) of the first byte that UTF-8 text can't have."""
    nul = raw.find(b"\0")
    try:
        raw.decode("utf-8")
        return (nul, "nul") if nul >= 0 else None
    except UnicodeDecodeError as e:
        if 0 <= nul < e.start:
            return nul, "nul"
        lead = raw[e.start]
        second = raw[e.start + 1] if e.start + 1 < len(raw) else 0
        if "unexpected end" in e.reason:
            return e.start, "truncated"
        if lead in (0xC0, 0xC1) or (lead == 0xE0 and 0x80 <= second < 0xA0) or (lead == 0xF0 and 0x80 <= second < 0x90):
            return e.start, "overlong"
        return e.start, "surrogate" if lead == 0xED and second >= 0xA0 else "invalid"


def _refuse(batches):
    for b in batches:
        found = [refusal(x) or (-1, "") for x in b["content"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["path"], pa.array([o for o, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], names=["doc_id", "path", "offset", "reason"])


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, fields that don't apply left out; a path that exists is refused."""
    records.select(F.to_json(F.struct(F.lit(RECORDS_SCHEMA).alias("schema"), *records.columns)).alias("value")).write.mode("error").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines; a malformed line or another schema fails the read."""
    df = spark.read.schema(f"schema string, {SCHEMA}").option("mode", "FAILFAST").json(path)
    known = F.when(F.col("schema") == RECORDS_SCHEMA, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown schema "), F.coalesce("schema", F.lit("none")))).cast("boolean"))
    return df.where(known).drop("schema")


def save(docs: DataFrame, path: str, keep_previous: bool = True) -> None:
    """All or nothing, on any file system of the cluster: written beside the target, the old version kept as .bak where asked, then put in its place."""
    spark = docs.sparkSession
    name = spark._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = name(path), name(f"{path}.new"), name(f"{path}.bak")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and (not keep_previous or fs.exists(old)):
        raise FileExistsError(f"{old.toString()} is in the way" if keep_previous else f"{path} is there")
    docs.write.mode("error").parquet(f"{path}.new")
    for a, b in [(target, old)] * held + [(fresh, target)]:
        if not fs.rename(a, b):
            raise OSError(f"{a.toString()} couldn't be renamed")


def find_up(start: str, names: Sequence[str]) -> str | None:
    """The nearest file of one of these names, from a folder upwards."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for n in names:
            if (folder / n).is_file():
                return str(folder / n)
    return None


KNOWN = {"glossary": str, "roots": list, "suppress": list, "bibliography": list, "warnings": bool, "fix_flags": list, "max_level": int, "schema": list}


def load_config(path: str | None, **flags) -> dict:
    """Settings of a TOML file with flags over them; a key that isn't known, or of another type, is an error."""
    out = {}
    if path:
        with open(path, "rb") as f:
            out = tomllib.load(f)
    out |= {k: v for k, v in flags.items() if v is not None}
    for k, v in out.items():
        if k not in KNOWN:
            raise ValueError(f"unknown setting {k}")
        if not isinstance(v, KNOWN[k]):
            raise ValueError(f"{k} should be a {KNOWN[k].__name__}")
    return out


def load_glossary(path: str) -> list:
    """Terms of a glossary file: JSON, or YAML where its parser is installed; a list of entries, or a mapping with them as `terms`."""
    from quillspan.operators.terms import load

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no parser of YAML is installed") from e
        data = yaml.safe_load(text) or []
    else:
        data = json.loads(text)
    entries = data.get("terms") or [] if isinstance(data, dict) else data
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError(f"{path}: entries have to be mappings")
    return load(entries)


def state_dir(start: str) -> str:
    """Where runs are logged: the setting, a project's folder, else the user's."""
    if os.environ.get("QUILLSPAN_STATE"):
        return os.environ["QUILLSPAN_STATE"]
    marker = find_up(start, ["quillspan.toml", "pyproject.toml"])
    return os.path.join(os.path.dirname(marker), ".quillspan") if marker else os.path.expanduser("~/.local/state/quillspan")
