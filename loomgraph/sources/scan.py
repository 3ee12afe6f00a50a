"""Source trees as DataFrames: walk, fingerprint, incremental scans, manifests."""

from __future__ import annotations

import fnmatch
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.storage import Folder


#: Languages by file extension.
EXTENSIONS = {
    "c": "c h",
    "cpp": "cpp cc cxx hpp hh",
    "csharp": "cs",
    "bash": "sh bash bats",
    "go": "go",
    "java": "java",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts",
    "tsx": "tsx",
    "kotlin": "kt kts",
    "objc": "m mm",
    "php": "php",
    "python": "py",
    "ruby": "rb",
    "rust": "rs",
    "swift": "swift",
    "sql": "sql",
    "prisma": "prisma",
    "graphql": "graphql gql",
    "yaml": "yaml yml",
    "terraform": "tf",
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}
#: Directories that are never scanned, the largest file, and manifests whose change counts.
SKIP_DIRS = ["node_modules", ".git", "dist", "build", "out", "target", "vendor", "Pods", "DerivedData", ".gradle", ".idea", "__pycache__", ".next", ".expo", ".loomgraph"]
MAX_BYTES = 2_000_000
MANIFESTS = ["composer.json", "package.json", "requirements.txt", "pyproject.toml", "Pipfile", "setup.py"]
#: Alternative names of languages.
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "golang": "go", "c++": "cpp", "c#": "csharp", "cs": "csharp", "objective-c": "objc", "sh": "bash", "shell": "bash", "kt": "kotlin", "openapi": "yaml"}


def language_name(name: str) -> str | None:
    n = ALIASES.get(name.lower(), name.lower())
    return n if n in EXTENSIONS else None


def _listed(spark: SparkSession, root: str, content: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), "^" + _quoted(base) + "/", "")
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return files.select(*columns).withColumn("path", rel)


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def _wanted(df: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    skipped = F.col("path").rlike(r"(^|/)(" + "|".join(map(_quoted, SKIP_DIRS)) + r")/")
    hidden = F.col("path").rlike(r"(^|/)\.[^/]")
    bundled = F.col("path").rlike(r"\.(min|bundle)\.js$")
    return df.filter(ext.isin(list(LANGUAGE_OF)) & ~skipped & ~hidden & ~bundled & (F.col("length") <= MAX_BYTES))


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str, bool]]:
    """(directory, pattern, negated) of all ignore files, in order of path and line; small by nature.

    Listings leave hidden files out, so they are looked for in every directory above a listed file.
    """
    wanted = ~F.col("path").rlike(r"(^|/)(" + "|".join(map(_quoted, SKIP_DIRS)) + r"|\.[^/]*)/")
    parents = _listed(spark, root, False).filter(wanted).select(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("d")).distinct()
    folders = {""}
    for (d,) in parents.toLocalIterator():
        while d not in folders:
            folders.add(d)
            d = d.rpartition("/")[0]
    base, out = Folder(spark, root), []
    for rel in sorted(folders):
        text = base.read(f"{rel}/.gitignore" if rel else ".gitignore")
        for line in (text or "").splitlines():
            p = line.rstrip()
            if p and not p.startswith("#"):
                out.append((rel, p.lstrip("!"), p.startswith("!")))
    return out


def ignored(path: str, rules: list[tuple[str, str, bool]]) -> bool:
    """Whether the last rule that matches the path, or a directory above it, excludes it."""
    hit = False
    for folder, pattern, negated in rules:
        if folder and not path.startswith(folder + "/"):
            continue
        rel = path[len(folder) + 1 :] if folder else path
        only_dir, p = pattern.endswith("/"), pattern.strip("/")
        parts = rel.split("/")
        anchored = "/" in p or pattern.startswith("/")
        ends = range(1, len(parts) + (0 if only_dir else 1))
        tried = ["/".join(parts[:n]) for n in ends] if anchored else [parts[n - 1] for n in ends]
        if any(fnmatch.fnmatch(t, p.replace("**/", "*").replace("/**", "/*")) for t in tried):
            hit = not negated
    return hit


def lossy_text(content: Column) -> Column:
    """UTF-8 text of bytes that need not be valid; invalid ones become U+FFFD.  Only they go through Python."""
    valid = F.try_validate_utf8(content.cast("string"))

    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return F.coalesce(valid, F.pandas_udf(decode, "string")(F.when(valid.isNull(), content)))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, size, content, content_hash) of the files of a tree that hold source text.

    Lossy UTF-8; hidden, ignored, bundled and oversized files and build directories are left out.
    """
    files = _wanted(_listed(spark, root, True))
    rules = ignore_rules(spark, root)
    if rules:

        @F.pandas_udf("boolean")
        def left_out(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: ignored(p, rules))

        files = files.filter(~left_out("path"))
    languages = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", languages[ext].alias("language"), F.col("length").alias("size"), lossy_text(F.col("content")).alias("content"), F.xxhash64("content").alias("content_hash"))


def fingerprint(spark: SparkSession, root: str, version: str = "1") -> str:
    """A digest of version, paths, sizes and times of all files that matter; contents are not read."""
    listed = _listed(spark, root, False)
    names = F.substring_index("path", "/", -1)
    files = _wanted(listed).unionByName(listed.filter(names.isin(MANIFESTS) & ~F.col("path").contains("/"))).distinct()
    # Order-free sums of row hashes: no row list is gathered anywhere.
    h = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    r = files.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).first()
    return f"{version}-{r['n']}-" + "-".join(f"{int(r[x] or 0):x}" for x in "abc")


def split_cached(files: DataFrame, cache: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the cache that are still valid, files to extract): a row is valid if path and hash agree."""
    if cache is None:
        return None, files
    keys = ["path", "content_hash"]
    return cache.join(files.select(*keys), keys, "left_semi"), files.join(cache.select(*keys), keys, "left_anti")


def skipped_files(files: DataFrame, processed: DataFrame, limit: int = 50) -> tuple[int, list[str]]:
    """How many files were not processed, and the first of them by path."""
    left = files.select("path").join(processed.select("path"), "path", "left_anti")
    return left.count(), [r[0] for r in left.orderBy("path").limit(limit).collect()]


def manifest_evidence(spark: SparkSession, root: str) -> list[str]:
    """Lower-case dependency names of the root's manifests, and the text of Python ones."""
    base, out = Folder(spark, root), []
    for name in MANIFESTS:
        text = base.read(name)
        if text is None:
            continue
        if name.endswith(".json"):
            try:
                data = json.loads(text)
            except ValueError:
                continue
            for part in ("require", "require-dev", "dependencies", "devDependencies"):
                deps = data.get(part) if isinstance(data, dict) else None
                out += [k.lower() for k in deps] if isinstance(deps, dict) else []
        else:
            out.append(text.lower())
    return out


