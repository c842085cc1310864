"""Record files: JSON lines, fenced blocks and tables in documents, lock files, tensor headers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, defects) of a file, a folder or a tree of JSON lines, each with the file it came from. With a
    schema nothing is inferred; lines that are no JSON object, or do not fit, are defects with their text."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where("trim(value) <> ''")
    if schema is None:
        read = spark.read.option("recursiveFileLookup", True).json(path).schema
        schema = T.StructType([f for f in read.fields if f.name != "_corrupt_record"])
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()
    parsed = lines.withColumn("_r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    ok = F.col("_r._bad").isNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.where(ok).select("source_file", *(F.col(f"_r.{n}").alias(n) for n in names)), parsed.where(~ok).select("source_file", F.col("value").alias("text"))


def fenced_records(texts: DataFrame, id_: str, text: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """(id, block, defect, fields): each JSON object in a ```json block of a document. `defect` tells blocks that
    are no JSON or lack a required field; their fields are null."""
    blocks = texts.select(id_, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)```json[^\n]*\n(.*?)\n\s*```"), F.lit(1))).alias("block", "_b"))
    parsed = blocks.withColumn("_p", F.try_parse_json("_b")).withColumn("_r", F.from_json("_b", schema))
    missing = F.array_compact(F.array(*(F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in required))) if required else F.array().cast("array<string>")
    defect = F.when(F.col("_p").isNull(), "no json").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
    return parsed.select(id_, "block", defect.alias("defect"), F.when(defect.isNull(), F.col("_r")).alias("_f")).select(id_, "block", "defect", "_f.*")


def table_rows(texts: DataFrame, id_: str, text: str, bare: bool = False) -> DataFrame:
    """(id, line_no, cells): rows of pipe tables in documents, without rules between header and body. With `bare`
    rows need no pipes at their ends, but two inside."""
    shape = r"^[^|]+\|[^|]+\|[^|].*$" if bare else r"^\s*\|.*\|\s*$"
    lines = texts.select(id_, F.posexplode(F.split(F.col(text), "\n")).alias("_n", "_l")).where(F.col("_l").rlike(shape) & ~F.col("_l").rlike(r"^[\s|:\-]+$"))
    inner = F.regexp_replace("_l", r"^\s*\||\|\s*$", "")
    return lines.select(id_, (F.col("_n") + 1).alias("line_no"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def lock_packages(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, name, version, source, dependency) of lock files with [[package]] tables: one row for each dependency
    (name, or name and version), one with a null dependency for a package without any."""
    packages = texts.select(id_, F.explode(F.regexp_extract_all(F.concat(F.col(text), F.lit("\n[[")), F.lit(r"(?s)\[\[package\]\]\n(.*?)(?=\n\[)"), F.lit(1))).alias("_p"))
    field = lambda n: F.nullif(F.regexp_extract("_p", rf'(?m)^{n} = "([^"]*)"', 1), F.lit(""))
    inside = F.regexp_extract("_p", r"(?s)dependencies = \[(.*?)\]", 1)
    return packages.select(id_, field("name").alias("name"), field("version").alias("version"), field("source").alias("source"), F.explode_outer(F.regexp_extract_all(inside, F.lit('"([^"]+)"'), F.lit(1))).alias("dependency"))


#: Bits of an element of each tensor type.
BITS = {"F64": 64, "I64": 64, "U64": 64, "F32": 32, "I32": 32, "U32": 32, "F16": 16, "BF16": 16, "I16": 16, "U16": 16, "I8": 8, "U8": 8, "BOOL": 8, "F8_E4M3": 8, "F8_E5M2": 8}
#: Longest header that is read.
MAX_HEADER = 100 << 20


def tensor_catalogue(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, name, dtype, shape, begin, end, bits, defect) of tensor files: eight bytes with the header's length, a JSON
    header, the data. A file that cannot be read is a row with a defect; sizes that do not fit are defects too."""
    schema = "path string, name string, dtype string, shape array<bigint>, begin bigint, end bigint, bits int, defect string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["_path"], pdf["_content"]):
                try:
                    (n,) = struct.unpack("<Q", data[:8])
                    if n > min(MAX_HEADER, len(data) - 8):
                        raise ValueError("header longer than the file")
                    header = json.loads(data[8 : 8 + n])
                    for name, t in sorted(header.items()):
                        if name == "__metadata__":
                            continue
                        bits, (a, b) = BITS.get(t["dtype"]), t["data_offsets"]
                        count = 1
                        for x in t["shape"]:
                            count *= x
                        bad = "unknown type" if bits is None else "size does not fit the shape" if count * bits != (b - a) * 8 else "beyond the file" if 8 + n + b > len(data) else None
                        rows.append((p, name, t["dtype"], t["shape"], a, b, bits, bad))
                except (struct.error, ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((p, None, None, None, None, None, None, f"unreadable: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "begin", "end", "bits", "defect"])

    return files.select(F.col(path).alias("_path"), F.col(content).alias("_content")).mapInPandas(read, schema)
