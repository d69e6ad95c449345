"""Counts and inventories for reports: each is one aggregation of the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import text as X

SEVERITIES = ("info", "low", "medium", "high", "critical")
EXPORTED = (
    "content.password_assignment_indicators", "content.secret_assignment_indicators", "content.note_style_credential_pair_indicators", "content.password_note_value_indicators",
    "content.database_connection_string_indicators", "dbinspect.access.connection_string", "dbinspect.access.dsn", "awsinspect.content.credentials_bundle", "content.gpp_cpassword_review_indicator",
)


def by_category(findings: DataFrame) -> DataFrame:
    """Findings of each category, by severity, and the highest one."""
    n = lambda s: F.count_if(X.norm(F.col("severity")) == s).alias(s)
    top = F.max(F.struct(X.severity_rank(F.col("severity")).alias("r"), X.norm(F.col("severity")).alias("s")))["s"]
    return findings.groupBy("category").agg(F.count("*").alias("n"), *[n(s) for s in SEVERITIES[1:]], top.alias("highest"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings of each of the five severities, those without any too."""
    wide = findings.agg(*[F.count_if(X.norm(F.col("severity")) == s).alias(s) for s in SEVERITIES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])).alias("x")).select("x.*")


def by_host(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Findings, shares and categories of each host and whether it has critical ones; ``top``: the hosts with most."""
    rows = findings.groupBy("host").agg(
        F.count("*").alias("n"), F.count_distinct("share").alias("shares"), F.count_distinct("category").alias("categories"), F.bool_or(X.norm(F.col("severity")) == "critical").alias("has_critical"), F.bool_or(F.col("from_sysvol")).alias("has_policy_share")
    )
    return rows if top is None else rows.orderBy(F.desc("n"), "host").limit(top)


def benchmark_counts(findings: DataFrame) -> DataFrame:
    """Counts by category, by severity and by rule, in one pass: ``kind``, ``name``, ``n``."""
    g = findings.groupingSets([[F.col("category")], [F.col("severity")], [F.col("rule_id")]], F.col("category"), F.col("severity"), F.col("rule_id")).agg(F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping("severity").alias("gs"))
    kind = F.when(F.col("gc") == 0, "category").when(F.col("gs") == 0, "severity").otherwise("rule")
    name = F.when(F.col("gc") == 0, F.col("category")).when(F.col("gs") == 0, F.col("severity")).otherwise(F.col("rule_id"))
    return g.select(kind.alias("kind"), name.alias("name"), "n")


def filter_options(findings: DataFrame) -> DataFrame:
    """One row of the distinct values that a report filters by, joined."""
    values = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c)
    return findings.agg(*[values(c) for c in ("category", "severity", "source", "signal_type")])


def scan_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: hosts, shares, files and bytes looked at, and findings."""
    seen = files.agg(F.count_distinct("host").alias("hosts"), F.count_distinct("host", "share").alias("shares"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return seen.crossJoin(findings.agg(F.count("*").alias("findings"), F.count_distinct("file_id").alias("files_with_findings")))  # one row each


def classes(findings: DataFrame) -> DataFrame:
    return findings.groupBy("triage_class").agg(F.count("*").alias("n"))


def backup_inventory(files: DataFrame) -> DataFrame:
    """Backup files by extension: places, bytes and the largest."""
    rows = files.where(F.lower("extension").isin(".bak", ".wim", ".mtf")).dropDuplicates(["host", "share", "file_path"])
    return rows.groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def credential_inventory(findings: DataFrame, redacted: bool = True) -> DataFrame:
    """Exportable credentials, one row for each rule, host and value, with all its places.

    The value is a digest unless ``redacted`` is off.
    """
    rows = findings.where(F.col("rule_id").isin(*EXPORTED) & (X.strip(F.col("match")) != ""))
    value = X.strip(F.col("match"))
    rows = rows.select("rule_id", "host", (F.substring(F.sha2(value, 256), 1, 16) if redacted else value).alias("value"), "share", "file_path")
    return rows.groupBy("rule_id", "host", "value").agg(F.count_distinct("share", "file_path").alias("n_places"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "share", "file_path"))), ";").alias("places"))


def validation(findings: DataFrame) -> DataFrame:
    """One row: actionable findings, those that may be false, and their share."""
    doubt = ~F.col("actionable") | F.col("triage_class").isin("config-only", "weak-review") | (F.col("confidence") == "low")
    rows = findings.agg(F.count("*").alias("n"), F.count_if("actionable").alias("actionable"), F.count_if(doubt).alias("doubtful"))
    return rows.withColumn("doubtful_share", F.round(F.coalesce(F.try_divide("doubtful", "n"), F.lit(0.0)), 6))


def unique_targets(targets: DataFrame) -> DataFrame:
    """Targets (``seq host ip source``), the first of each: by address, else by host name."""
    key = F.coalesce(F.nullif(X.norm(F.col("ip")), F.lit("")), F.nullif(X.norm(F.col("host")), F.lit("")))
    rows = targets.withColumn("__k", key).where("__k is not null")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy("seq"))).where("__n = 1").drop("__k", "__n")


def target_audit(targets: DataFrame, planned: DataFrame) -> DataFrame:
    """Each target, whether it was scanned (known by host or address), and why not."""
    by_host = planned.select(X.norm(F.col("host")).alias("h"), F.lit(True).alias("as_host")).distinct()
    by_ip = planned.where("ip <> ''").select(X.norm(F.col("ip")).alias("i"), F.lit(True).alias("as_ip")).distinct()
    rows = targets.join(by_host, X.norm(F.col("host")) == F.col("h"), "left").join(by_ip, X.norm(F.col("ip")) == F.col("i"), "left")
    scanned = F.coalesce("as_host", "as_ip", F.lit(False))
    reason = F.when(scanned, "").when(~F.col("reachable"), "unreachable").otherwise("not planned")
    return rows.select("seq", "host", "ip", "source", "reachable", scanned.alias("scanned"), reason.alias("skip_reason"))


def target_stats(targets: DataFrame) -> DataFrame:
    """One row: targets loaded, different, reachable and skipped."""
    kept = unique_targets(targets).agg(F.count("*").alias("unique_targets"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("skipped"))
    return targets.agg(F.count("*").alias("loaded")).crossJoin(kept)  # one row each


def dfs_targets(rows: DataFrame, column: str) -> DataFrame:
    """Servers, shares and paths of all UNC names in a text column."""
    found = rows.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\\\\[A-Za-z0-9._-]+\\[^\\\s,;\"<>|]+(?:\\[^\s,;\"<>|]+)*"), F.lit(0))).alias("unc"))
    part = F.split(F.substring("unc", 3, 1 << 20), r"\\")
    path = F.array_join(F.slice(part, 3, F.greatest(F.size(part) - 2, F.lit(0))), "/")
    return found.select("unc", F.lower(F.get(part, F.lit(0))).alias("server"), F.get(part, F.lit(1)).alias("share"), path.alias("path")).dropDuplicates(["server", "share", "path"])


def dfs_shares(shares: DataFrame, hints: DataFrame) -> DataFrame:
    """Shares with those that only hints know; ``from_dfs`` marks what a hint names."""
    h = hints.select(F.lower("server").alias("host"), "share").distinct().withColumn("from_dfs", F.lit(True))
    return shares.select(F.lower("host").alias("host"), "share").distinct().join(h, ["host", "share"], "full_outer").withColumn("from_dfs", F.coalesce("from_dfs", F.lit(False)))
