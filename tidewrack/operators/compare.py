"""Findings against something else: a baseline, expectations, a manifest, and what an earlier run completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import text as X

KEY = ("rule", "host_key", "share_key", "path", "match_key")
FIELDS = ("category", "severity", "confidence", "confidence_score", "context", "triage_class", "signal_type")


def keyed(findings: DataFrame) -> DataFrame:
    """``findings`` with the five columns of a fingerprint."""
    path = F.replace(X.norm(F.col("file_path")), F.lit("\\"), F.lit("/"))
    # a null counts as nothing, else no key that holds one would ever meet its like
    made = {n: F.coalesce(c, F.lit("")) for n, c in zip(KEY, (X.norm(F.col("rule_id")), X.norm(F.col("host")), X.norm(F.col("share")), path, X.norm(F.col("match"))))}
    return findings.withColumns(made)


def runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The findings of two runs in one table, told apart by ``run``: ``before`` and ``now``."""
    both = [c for c in baseline.columns if c in current.columns]
    side = lambda df, name: df.select(*both, F.lit(name).alias("run"))
    return side(baseline, "before").unionByName(side(current, "now"))


def diff_runs(rows: DataFrame) -> DataFrame:
    """Two runs (:func:`runs`) side by side: the fingerprint, ``status`` and ``changed_fields``.

    Status: ``new``, ``removed``, ``changed`` if a field differs, else
    ``unchanged``. Of duplicates in a run the last in order of all fields counts.
    """
    fields = [c for c in FIELDS if c in rows.columns]
    last = lambda run: F.max(F.when(F.col("run") == run, F.struct(*fields)))
    rows = keyed(rows).groupBy(*KEY).agg(last("before").alias("b"), last("now").alias("c"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}")), f) for f in fields]))
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    rows = rows.withColumn("changed_fields", F.when(both, F.array_join(differ, ",")).otherwise(""))
    status = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "removed").when(F.col("changed_fields") != "", "changed").otherwise("unchanged")
    return rows.select(*KEY, status.alias("status"), "changed_fields")


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """:func:`diff_runs` of two tables of findings."""
    return diff_runs(runs(baseline, current))


def class_deltas_of_runs(rows: DataFrame, by: str) -> DataFrame:
    """Counts of a column's values in two runs (:func:`runs`): ``before``, ``now`` and ``delta``; nulls of both don't meet."""
    count = lambda run: F.count_if(F.col("run") == run).alias(run)
    g = rows.groupBy(F.col(by), F.when(F.col(by).isNull(), F.col("run")).alias("__apart")).agg(count("before"), count("now")).drop("__apart")
    return g.withColumn("delta", F.col("now") - F.col("before"))


def class_deltas(baseline: DataFrame, current: DataFrame, by: str) -> DataFrame:
    """:func:`class_deltas_of_runs` of two tables of findings."""
    return class_deltas_of_runs(runs(baseline, current), by)


def _path(c: Column) -> Column:
    return F.lower(X.slashes(X.strip(c)))


def judge(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Each expectation's outcome: ``id``, ``matched``, ``n_findings``, ``severity_ok``, ``confidence_ok``.

    A finding meets an expectation with its path and category, one of whose
    ``rule_ids`` it has (any, where there are none). The flags say whether one
    of them is severe and confident enough.
    """
    return _outcomes(_met(findings, labels, "left"), "id")


def _met(findings: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    """Expectations beside the findings of their path and category; ``id`` and ``expected``, null where nothing was expected, and the finding's."""
    f = findings.select(_path(F.col("file_path")).alias("p"), X.norm(F.col("category")).alias("c"), X.norm(F.col("rule_id")).alias("rule"), X.severity_rank(F.col("severity")).alias("s"), X.confidence_rank(F.col("confidence")).alias("k"))
    e = labels.select("id", F.lit(True).alias("expected"), _path(F.col("path")).alias("p"), X.norm(F.col("category")).alias("c"), F.transform("rule_ids", X.norm).alias("wanted"), X.severity_rank(F.col("minimum_severity")).alias("least_s"), X.confidence_rank(F.col("minimum_confidence")).alias("least_k"))
    return e.join(f, ["p", "c"], how)


def _outcomes(rows: DataFrame, *by: str) -> DataFrame:
    hit = F.col("rule").isNotNull() & ((F.size("wanted") == 0) | F.array_contains("wanted", F.col("rule")))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy(*by).agg(yes(hit).alias("matched"), F.count_if(hit).alias("n_findings"), yes(hit & (F.col("s") >= F.col("least_s"))).alias("severity_ok"), yes(hit & (F.col("k") >= F.col("least_k"))).alias("confidence_ok"))


def noisy(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings whose path and category nothing was expected of."""
    e = labels.select(_path(F.col("path")).alias("__p"), X.norm(F.col("category")).alias("__c"))
    rows = findings.withColumns({"__p": _path(F.col("file_path")), "__c": X.norm(F.col("category"))})
    return rows.join(e, ["__p", "__c"], "left_anti").drop("__p", "__c")


def judge_summary(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: expected, matched, missed and noisy counts, and precision and recall of them. The findings are gone through once."""
    rows = _met(findings, labels, "full_outer")
    hit = F.col("rule").isNotNull() & ((F.size("wanted") == 0) | F.array_contains("wanted", F.col("rule")))
    each = rows.groupBy("id", "expected").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("met"), F.count("*").alias("n"))
    there = F.col("expected").isNotNull()
    rows = each.agg(F.count_if(there).alias("expected"), F.count_if(there & F.col("met")).alias("matched"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).cast("long").alias("noisy"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.select("expected", "matched", (F.col("expected") - F.col("matched")).alias("missed"), "noisy", share(F.col("matched"), F.col("matched") + F.col("noisy")).alias("precision_like"), share(F.col("matched"), F.col("expected")).alias("recall_like"))


def verify(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planted items and what was found of them: the item, ``found`` and the highest ``observed`` severity rank. Filler isn't expected."""
    key = lambda c: X.norm(F.col(c))
    f = findings.groupBy(key("host").alias("h"), key("share").alias("s"), _path(F.col("file_path")).alias("p")).agg(F.max(X.severity_rank(F.col("severity"))).alias("observed"))
    m = manifest.where(~key("intended_as").isin("filler", "noise")).withColumns({"h": key("host"), "s": key("share"), "p": _path(F.col("path"))})
    rows = m.join(f, ["h", "s", "p"], "left").drop("h", "s", "p")
    return rows.withColumns({"found": F.col("observed").isNotNull(), "observed": F.coalesce("observed", F.lit(0))})


def unexpected(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Findings at places that the manifest doesn't name."""
    key = lambda c: X.norm(F.col(c))
    m = manifest.select(key("host").alias("__h"), key("share").alias("__s"), _path(F.col("path")).alias("__p"))
    rows = findings.withColumns({"__h": key("host"), "__s": key("share"), "__p": _path(F.col("file_path"))})
    return rows.join(m, ["__h", "__s", "__p"], "left_anti").drop("__h", "__s", "__p")


def coverage(verified: DataFrame, by: str) -> DataFrame:
    """Expected, found and missed planted items by a column."""
    return verified.groupBy(F.col(by)).agg(F.count("*").alias("expected"), F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missed"))


def resume(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that an earlier run hasn't completed in their present size and time."""
    return files.join(done.select("host", "share", "file_path", "size", "modified_at"), ["host", "share", "file_path", "size", "modified_at"], "left_anti")


def completed_shares(outcomes: DataFrame) -> DataFrame:
    """Shares of which every file succeeded and whose listing was finished (``ok``, ``listed``)."""
    return outcomes.groupBy("host", "share").agg(F.count("*").alias("n_files"), F.bool_and(F.col("ok") & F.col("listed")).alias("completed"))
