"""Repository scans: admission of code and artifact files by path, before contents are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import IGNORED_DIRS

# Extension -> language of files that the walker admits.
CODE = {
    "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "java": "java", "cs": "csharp", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "hxx": "cpp", "rake": "ruby",
}
#: Extensions the parser knows beyond the walker's.
PARSER = CODE | {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "mts": "typescript", "cts": "typescript", "pyi": "python", "c++": "cpp"}
ARTIFACT = {"md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "sql": "sql"}
CI_FILES = ("Jenkinsfile", "Dockerfile", ".gitlab-ci")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def language_of(path: Column, ci: tuple[str, ...] = CI_FILES) -> Column:
    """Language of an admitted path: code first, then artifacts by extension, then CI descriptors as YAML."""
    ext = extension(path)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    descriptor = F.lit(False)
    for part in ci:
        descriptor = descriptor | F.contains(name, F.lit(part))
    return F.coalesce(_lookup(ext, CODE), _lookup(ext, ARTIFACT), F.when(descriptor, "yaml"))


def pruned(path: Column, ignored: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """Whether a directory name on the path is ignored."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*ignored, ".index", ".git"))


def walk(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """``path, language, content, size_bytes, content_hash`` of admitted files under ``root``.

    Path filters apply before contents are decoded. Files of zero bytes are not listed by the binary reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    bare = F.regexp_replace("path", "^[a-z]+:/*", "")
    rel = F.ltrim(F.substr(bare, F.length(base) + 1), F.lit("/"))
    admitted = files.select(rel.alias("path"), "content", F.col("length").alias("size_bytes")).where(~pruned(F.col("path"), ignored))
    return admitted.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL").withColumn("content_hash", F.sha2("content", 256))
