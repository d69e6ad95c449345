"""Which files are looked at, and which of their contents are read: metadata only, before any content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.functions.regex import to_java
from tidewrack.operators import inspect_db, inspect_paths

ARCHIVES = (".zip", ".docx", ".xlsx", ".pptx", ".tar", ".tar.gz", ".tgz")
SQLITE = (".sqlite", ".sqlite3", ".db", ".db3")
MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Size limits in bytes; 0 means none."""

    max_file: int = 0
    max_read: int = 10 * MIB
    archive_auto: int = 10 * MIB
    archive_max: int = 10 * MIB
    sqlite: int = 5 * MIB
    wim: int = 128 * MIB
    archives: bool = True
    wims: bool = True
    sqlites: bool = True


def eligible(rule: dict) -> Column:
    """Size, extension and path conditions of a rule."""
    out = F.lit(True)
    path = F.lower("file_path")
    if rule["max_file_size"]:
        out = out & (F.col("size") <= rule["max_file_size"])
    if rule["file_extensions"]:
        out = out & F.lower("extension").isin([e.lower() if e.startswith(".") else "." + e.lower() for e in rule["file_extensions"]])
    if rule["include_paths"]:
        out = out & X.contains_any(path, [p.lower() for p in rule["include_paths"]])
    if rule["exclude_paths"]:
        out = out & ~X.contains_any(path, [p.lower() for p in rule["exclude_paths"]])
    return out


def archive_extension() -> Column:
    """Extension as archives count it: ``.tar.gz`` is one."""
    return F.when(F.lower("name").endswith(".tar.gz"), ".tar.gz").otherwise(F.lower("extension"))


def skip_rule(rules: list[dict]) -> Column:
    """Id of the first skip rule that a file meets, null if none."""
    ext = F.when(archive_extension().isin(*ARCHIVES), archive_extension()).otherwise(F.lower("extension"))
    out = []
    for r in rules:
        if r["action"] == "skip":
            on = ext if r["type"] == "extension" else F.col("name")
            out.append(F.when(eligible(r) & on.rlike(to_java(r["pattern"], not r["case_sensitive"])), r["id"]))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


@X.untraced
def decide(files: DataFrame, rules: list[dict], limits: Limits = Limits()) -> DataFrame:
    """``files`` with ``skip_reason`` (null: looked at), ``kind`` and ``needs_content``.

    Kinds: ``archive``, ``wim``, ``sqlite`` and ``standard``. In the order of
    evaluation: skip rules, then the limits of a kind, then the file limit,
    which archives and images escape.
    """
    ext = archive_extension()
    kind = F.when(ext.isin(*ARCHIVES), "archive").when(ext == ".wim", "wim").when(ext.isin(*SQLITE), "sqlite").otherwise("standard")
    reason = (
        F.when(F.col("kind") == "archive", F.when(F.lit(not limits.archives), "archive inspection is disabled").when((F.lit(limits.archive_auto) > 0) & (F.col("size") > min(limits.archive_auto, limits.archive_max)), "archive exceeds its size limit"))
        .when(F.col("kind") == "wim", F.when(F.lit(not limits.wims), "image inspection is disabled").when(F.col("size") > limits.wim, "image exceeds its size limit"))
        .when((F.col("kind") == "sqlite") & F.lit(not limits.sqlites), "database inspection is disabled")
        .when((F.col("kind") == "sqlite") & (F.col("size") > limits.sqlite), "database exceeds its size limit")
        .when((F.lit(limits.max_file) > 0) & (F.col("size") > limits.max_file), "file exceeds the size limit")
    )
    out = X.once(files, skip_rule=X.aside(skip_rule(rules)), kind=kind)
    out = X.once(out, skip_reason=F.when(F.col("skip_rule").isNotNull(), "matched skip rule").otherwise(reason))
    wanted = (F.col("size") <= limits.max_read) if limits.max_read else F.lit(True)
    content = F.lit(False)
    for r in rules:
        if r["type"] == "content" and r["action"] != "skip":
            content = content | eligible(r)
    reads = (wanted & content) | inspect_paths.is_aws() | inspect_paths.is_key() | inspect_db.needs_content() | F.col("kind").isin("archive", "wim", "sqlite")
    return X.once(out, needs_content=X.aside(F.col("skip_reason").isNull() & reads))
