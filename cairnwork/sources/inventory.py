"""Directory inventories: every file a row, unreadable or not."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "mjs": "javascript", "js": "javascript", "py": "python", "go": "go", "java": "java", "rb": "ruby", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}
#: Classes of files without a language, by extension.
CLASSES = {
    "image": "png jpg jpeg gif webp avif heic heif bmp ico tif tiff", "video": "mp4 mov webm mkv avi", "audio": "wav mp3 ogg flac aac m4a", "document": "pdf docx doc odt pptx xlsx",
    "cad_3d": "step stp iges igs stl obj gltf glb fbx 3mf", "electronics": "kicad_pcb kicad_sch kicad_pro brd sch gbr", "ui_design": "fig sketch psd xd",
}


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part; empty when there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".\.([^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language(path: Column) -> Column:
    """The language that the extension names, or null."""
    return _lookup(LANGUAGES, extension(path))


def artifact_class(path: Column) -> Column:
    """The class of a file without a language: by extension, an unlisted extension being its own class."""
    e = extension(path)
    return F.coalesce(_lookup({x: k for k, v in CLASSES.items() for x in v.split()}, e), F.when(e == "", "(no extension)").otherwise(F.concat(F.lit("."), e)))


def scan_inventory(spark: SparkSession, root: str, declared: Sequence[str] | None = None, ignored: Sequence[str] = (".git", "target", "node_modules")) -> DataFrame:
    """(path, bytes, modified, kind, language, disposition, reason, content_digest) of all files under `root`, or
    under its `declared` parts only, which are pruned before anything is listed. A declared root that leaves
    `root` is a row of disposition `rejected`; ignored directories are passed over.
    """
    base = os.path.abspath(root)
    inside, refused = [], []
    for d in declared if declared is not None else [""]:
        full = os.path.normpath(os.path.join(base, d))
        (inside if full == base or full.startswith(base + "/") else refused).append((d, full))
    schema = "path string, bytes bigint, modified timestamp, kind string, language string, disposition string, reason string, content_digest string"
    out = spark.createDataFrame([(d, None, None, "ROOT", None, "rejected", "declared root leaves the source", None) for d, _ in refused], schema)
    there = [full for _, full in inside if os.path.exists(full)]
    out = out.unionByName(spark.createDataFrame([(d, None, None, "ROOT", None, "missing", "declared root does not exist", None) for d, full in inside if not os.path.exists(full)], schema))
    if there:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
        rel = F.substring(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "%20", " "), len(base) + 2, 1 << 20)
        skip = F.arrays_overlap(F.split(rel, "/"), F.array(*(F.lit(x) for x in ignored))) if ignored else F.lit(False)
        lang = language(rel)
        out = out.unionByName(files.where(~skip).select(rel.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.lit("FILE").alias("kind"), lang.alias("language"), F.when(lang.isNotNull(), "parsed").otherwise("classified").alias("disposition"), F.when(lang.isNull(), artifact_class(rel)).alias("reason"), F.sha2("content", 256).alias("content_digest")))
    return out


def long_files(texts: DataFrame, path: str, text: str, limit: int) -> DataFrame:
    """Files with more lines than the limit."""
    return texts.select(path, F.size(F.split(text, "\n")).alias("n_lines")).where(F.col("n_lines") > limit)
