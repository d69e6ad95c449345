"""What is left of findings after review: suppression, duplicates, and material that stands in several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import text as X

#: Criteria of a suppression rule, and how they compare with a finding.
CRITERIA = ("hosts", "shares", "rule_ids", "categories", "exact_paths", "path_prefixes", "path_contains", "fingerprints", "tags")


def fingerprint() -> Column:
    """Rule, host, share, path and match in the form that findings compare in."""
    path = F.replace(X.norm(F.col("file_path")), F.lit("\\"), F.lit("/"))
    return F.concat_ws("|", X.norm(F.col("rule_id")), X.norm(F.col("host")), X.norm(F.col("share")), path, X.norm(F.col("match")))


def _meets(rule: dict) -> Column:
    """All criteria that the rule has, any value of each; never without criteria."""
    path = F.lower(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")))
    tests = {
        "hosts": lambda v: X.norm(F.col("host")) == v, "shares": lambda v: X.norm(F.col("share")) == v, "rule_ids": lambda v: X.norm(F.col("rule_id")) == v,
        "categories": lambda v: X.norm(F.col("category")) == v, "exact_paths": lambda v: path == v, "path_prefixes": lambda v: path.startswith(v),
        "path_contains": lambda v: path.contains(v), "fingerprints": lambda v: fingerprint() == v, "tags": lambda v: F.exists(F.col("tags"), lambda t: X.norm(t) == v),
    }
    out = None
    for name in CRITERIA:
        values = [v.strip().lower() for v in rule.get(name, ()) if v.strip()]
        if values:
            some = F.lit(False)
            for v in values:
                some = some | tests[name](v)
            out = some if out is None else out & some
    return F.lit(False) if out is None else out


def suppressed_by(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """``findings`` with ``suppression_id``: the first enabled rule that each meets, null if none.

    Rules are configuration, so they are compiled into one expression: no join.
    """
    cases = [F.when(_meets(r), r["id"]) for r in rules if r.get("enabled", False)]
    return findings.withColumn("suppression_id", F.coalesce(*cases) if cases else F.lit(None).cast("string"))


def survivors(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings that no rule suppresses."""
    return suppressed_by(findings, rules).where("suppression_id is null").drop("suppression_id")


#: Parts that a group is cut into by hash where groups are few and large.
PARTS = 256


def suppression_summary(findings: DataFrame, rules: list[dict], sample: int = 3) -> DataFrame:
    """``suppression_id``, ``n`` and the first ``sample`` fingerprints.

    Rules are few, so each one's findings are counted and sorted in parts.
    """
    rows = suppressed_by(findings, rules).where("suppression_id is not null").select("suppression_id", fingerprint().alias("f"))
    rows = X.once(rows, part=F.pmod(F.xxhash64("f"), F.lit(PARTS)))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("suppression_id", "part").orderBy("f")))
    parts = rows.groupBy("suppression_id", "part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("at") <= sample, F.col("f"))).alias("first"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, sample)
    return parts.groupBy("suppression_id").agg(F.sum("n").alias("n"), F.array_join(first, ";").alias("samples"))


def exact_dedup(findings: DataFrame) -> DataFrame:
    """One finding of those that agree in host, share, path, rule, category and match: the highest score, then severity."""
    keys = [X.norm(F.col(c)) for c in ("host", "share", "file_path", "rule_id", "category", "match")]
    best = Window.partitionBy(*keys).orderBy(F.col("confidence_score").desc(), X.severity_rank(F.col("severity")).desc(), "rule_id", "file_path")
    return findings.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def duplicate_groups(findings: DataFrame, most: int = 20) -> DataFrame:
    """Material that stands in several places: rule, category, match, ``canonical``, ``n_places`` and the first ``places``.

    The canonical place has the greatest score, then the least path.
    """
    place = F.concat_ws("/", F.lower("host"), F.lower("share"), F.col("file_path"))
    rows = findings.where(X.strip(F.col("match")) != "").select("rule_id", "category", "match", "confidence_score", place.alias("place"))
    group = ["rule_id", "category", "match"]
    # material of one name may stand in a good share of all files, so its places are gone through in parts; one shuffle serves all steps up to those
    rows = X.once(rows, part=F.pmod(F.xxhash64("place"), F.lit(PARTS))).repartition(*group, "part").distinct()
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*group, "part").orderBy(F.col("confidence_score").desc(), "place")))
    one = F.struct(F.col("confidence_score").isNull().alias("unscored"), (-F.col("confidence_score")).alias("score"), "place")
    parts = rows.groupBy(*group, "part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("at") <= most, one)).alias("first"))
    g = parts.groupBy(*group).agg(F.sum("n").alias("n_places"), F.array_sort(F.flatten(F.collect_list("first"))).alias("first")).where("n_places > 1")
    return g.select(*group, F.get("first", F.lit(0))["place"].alias("canonical"), "n_places", F.array_join(F.array_sort(F.transform(F.slice("first", 1, most), lambda x: x["place"])), ";").alias("places"))
