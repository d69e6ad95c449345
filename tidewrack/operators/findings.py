"""From matches to findings: one row for each raw hit, then one for each file and category, scored and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import quality as Q
from tidewrack.functions import text as X
from tidewrack.operators import gating, inspect_db, inspect_paths, matching, planner
from tidewrack.sources.scratch import cut

TYPES = ("validated", "content", "filename", "extension", "path", "share_priority", "planner_priority")
CAPS = {"content": 40, "validated": 42, "filename": 24, "extension": 14, "path": 12, "share_priority": 12, "planner_priority": 14}
FILE = ("file_id", "host", "share", "file_path", "name", "extension", "size", "modified_at", "source", "from_sysvol", "from_netlogon", "priority", "priority_reason", "share_priority")
HIT = "seq int, rule_id string, rule_type string, signal_type string, category string, severity string, confidence string, match string, line int, context string, account string, tags array<string>, weight int, path_weight int"
DIRECT = (
    "filename.private_key_artifacts", "filename.secret_store_artifacts", "filename.windows_hive_artifacts", "filename.ad_database_backup_artifacts", "filename.windows_hive_backup_artifacts",
)
IDENTITY = "^(?:wincredinspect\\.path\\.|dbinspect\\.(?:artifact|infrastructure)\\.|browsercredinspect\\.|backupinspect\\.path\\.|awsinspect\\.path\\.(?:config|credentials)$)"
SUPPORTING = ("filename.ssh_supporting_artifacts", "extension.database_and_backup_extensions")


def _named(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The columns of a file and those of a hit."""
    kinds = dict(c.split() for c in HIT.split(", "))
    return rows.select(*FILE, *[values[n].cast(k).alias(n) for n, k in kinds.items()])


def _weight(signal: Column) -> Column:
    return F.coalesce(*[F.when(signal == t, w) for t, w in matching.WEIGHTS.items()], F.lit(0))


def _numbered(matches: Column, start: int, with_path: bool) -> Column:
    """Matches of a detector as hits, numbered from ``start``; a path signal may go with them."""
    fields = lambda m, i: {
        "seq": F.lit(start) + i, "rule_id": m["rule_id"], "rule_type": m["rule_type"], "signal_type": m["signal_type"], "category": m["category"], "severity": m["severity"], "confidence": m["confidence"], "match": m["match"],
        "line": m["line"], "context": m["text"], "account": F.lit(""), "tags": m["tags"], "weight": _weight(m["signal_type"]), "path_weight": F.lit(12 if with_path else 0),
    }
    return F.transform(matches, lambda m, i: _hit_struct(fields(m, i)))


def _hit_struct(values: dict[str, Column]) -> Column:
    kinds = dict(c.split() for c in HIT.split(", "))
    return F.struct(*[values[n].cast(k).alias(n) for n, k in kinds.items()])


def _of_rule(h: Column, content: bool) -> Column:
    values = {n: h[n] for n in ("seq", "rule_id", "rule_type", "category", "severity", "confidence", "match", "tags")} | {"signal_type": h["rule_type"], "weight": _weight(h["rule_type"]), "path_weight": F.lit(0)}
    more = {"line": h["line"], "context": X.limit(h["context"], 320), "account": X.limit(h["account"], 160)} if content else {"line": F.lit(0), "context": F.lit(""), "account": F.lit("")}
    return _hit_struct(values | more)


def _tagged(rows: DataFrame) -> DataFrame:
    """With the tags of where a file lies."""
    more = F.array_compact(F.array(F.when(F.col("from_sysvol"), "ad-share:sysvol"), F.when(F.col("from_netlogon"), "ad-share:netlogon"), F.when(F.lower("source").contains("dfs"), "source:dfs")))
    return rows.withColumn("tags", F.concat("tags", more))


@X.untraced
def planned(files: DataFrame) -> DataFrame:
    """``files`` with the priorities of a plan."""
    shares = planner.score_shares(files.drop("priority", "reason")).withColumnRenamed("priority", "share_priority").drop("reason")
    return planner.score_files(shares)


@X.untraced
def raw_findings(files: DataFrame, rules: list[dict], limits: gating.Limits = gating.Limits()) -> DataFrame:
    """All hits of rules and inspectors on files that aren't skipped, in the order ``seq`` within a file.

    Files of archives, images and databases are left to their readers, whose
    members come back as files. ``files`` needs the planner's columns.
    """
    looked = gating.decide(files, rules, limits).where("skip_reason is null and kind in ('standard', 'sqlite')").drop("skip_reason", "skip_rule", "kind")
    looked = X.once(looked, __path=inspect_paths.path(), __read=F.when(F.col("needs_content") & (F.col("text") != ""), F.col("text")))
    p, text = F.col("__path"), F.col("__read")
    named = F.transform(F.array_compact(F.array(*matching.metadata_hits(rules))), lambda h: _of_rule(h, False))
    placed = [
        (200, inspect_paths.backup_matches(p), True), (220, inspect_paths.aws_matches(p), True), (240, inspect_paths.browser_matches(p), True), (260, inspect_db.artifact_matches(), False), (280, inspect_paths.windows_matches(p), True),
    ]
    inside = [(2000, inspect_paths.aws_content_matches(text, p), True), (4000, inspect_db.dump_matches(text), False), (6000, inspect_paths.key_matches(text), False)]
    found = F.transform(matching.content_hits(rules, text), lambda h: _of_rule(h, True))
    every = F.concat(named, *[_numbered(a, s, w) for s, a, w in placed], F.when(text.isNotNull(), F.concat(found, *[_numbered(a, s, w) for s, a, w in inside])).otherwise(F.array()))
    rows = X.once(looked, __hits=X.aside(every)).select(*FILE, F.explode("__hits").alias("h")).select(*FILE, "h.*")
    out = [matching.drop_weak(rows, F.col("seq").between(1000, 1999)).drop("quality")]
    read = looked.where("__read is not null").drop("needs_content", "__path", "__read")
    tags = lambda kind: F.array(F.lit("database"), F.lit("db:source:config"), F.lit(f"db:type:{kind}"), F.concat(F.lit("db:ecosystem:"), F.col("ecosystem")))
    base = {n: F.col(n) for n in ("rule_id", "category", "severity", "match")} | {"rule_type": F.lit("content"), "signal_type": F.lit("validated"), "confidence": F.lit("high"), "account": F.lit(""), "weight": F.lit(40), "path_weight": F.lit(0)}
    kind = F.when(F.col("category") == "database-access", F.lit(True)).otherwise(False)
    either = F.when(kind, tags("config-credential")).otherwise(tags("server-indicator"))
    out.append(_named(inspect_db.tns_services(read), base | {"rule_id": F.lit("dbinspect.infrastructure.oracle_tns"), "category": F.lit("database-infrastructure"), "severity": F.lit("medium"), "seq": F.lit(3000) + F.col("line"), "line": F.col("line"), "context": F.col("match"),
                                                             "tags": F.array(*[F.lit(t) for t in ("database", "db:source:config", "db:type:server-indicator", "db:ecosystem:oracle")])}))
    out.append(_named(inspect_db.sections(read), base | {"seq": F.lit(3500), "line": F.lit(1), "context": F.col("match"), "tags": either}))
    out.append(_named(inspect_db.connections(read), base | {"seq": F.lit(5000) + F.least(F.col("line"), F.lit(999)), "line": F.col("line"), "context": X.limit(F.col("fragment"), 320), "tags": either}))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return _tagged(rows)


def finding_quality(types: Column, category: Column, blob: Column) -> Column:
    """Quality struct of a finding by its signals: structure counts most, names alone count nothing."""
    has = lambda t: F.array_contains(types, t)
    firm = F.when(X.norm(category).isin("deployment", "crypto", "credentials", "database-access"), Q._quality(18, "high", strong=True)).otherwise(Q._quality(14, "high", strong=True))

    def of_values(v: Column) -> Column:
        """One reading of the values serves connections and others."""
        of_connection = Q.is_connection(blob)
        extracted = X.let(Q.best_quality(v), lambda q: F.struct(q.alias("best"), F.when(of_connection, Q.connection_of(v, q)).alias("connection")))
        firm_one = lambda x: F.when(of_connection & (x["connection"]["score"] >= 14), x["connection"]).otherwise(firm)
        content = lambda x: F.when(of_connection, x["connection"]).when(x["best"]["score"] > 0, x["best"]).otherwise(Q._quality(8, "medium"))
        return X.let(extracted, lambda x: F.when(has("validated"), firm_one(x)).otherwise(content(x)))

    return F.when(has("validated") | has("content"), X.let(Q.sensitive_values(blob), of_values)).when(has("filename") | has("extension"), Q._quality(0, "low")).otherwise(Q.none())


def strong_evidence(rule_id: Column, signal: Column, quality: Column) -> Column:
    """Whether a finding stands on more than a name."""
    usable = ~quality["weak"] & ((signal == "content") | ((signal == "validated") & ~X.norm(rule_id).rlike(IDENTITY)))
    return (signal == "correlation") | usable | X.norm(rule_id).isin(*DIRECT)


def triage(rows: DataFrame) -> DataFrame:
    """Class, severity, score and confidence after triage; needs ``strong``, ``category`` and the scores."""
    rows = rows.withColumn("triage_class", F.when(F.col("strong"), "actionable").when(X.norm(F.col("category")) == "configuration", "config-only").otherwise("weak-review"))
    low, weak = F.col("triage_class") == "config-only", F.col("triage_class") == "weak-review"
    rank = X.severity_rank(F.col("severity"))
    return rows.withColumns(
        {
            "severity": F.when(low & (rank > 1), "low").when(weak & (rank > 2), "medium").otherwise(F.col("severity")),
            "confidence_score": F.when(low, F.least("confidence_score", F.lit(24))).when(weak, F.least("confidence_score", F.lit(34))).otherwise(F.col("confidence_score")),
            "confidence": F.when(low, "low").when(weak & ((F.col("confidence") == "") | (X.confidence_rank(F.col("confidence")) > 2)), "medium").otherwise(F.col("confidence")),
            "actionable": F.col("strong"),
        }
    )


def raw_severity(rows: DataFrame) -> DataFrame:
    """Raw findings with the severity that their own triage leaves them."""
    blob = F.coalesce(*[F.when(X.strip(F.col(c)) != "", F.col(c)) for c in ("context", "match")], F.lit(""))
    rows = X.once(rows, __q=X.let(blob, lambda b: finding_quality(F.array("signal_type"), F.col("category"), b)))
    rows = rows.withColumns({"strong": strong_evidence(F.col("rule_id"), F.col("signal_type"), F.col("__q")), "confidence_score": F.lit(0)}).drop("__q")
    kept = rows.select("*", F.col("confidence").alias("__c"))
    return triage(kept).withColumn("confidence", F.col("__c")).drop("__c", "strong", "confidence_score", "triage_class", "actionable")


def level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")


def primary(items: Column) -> Column:
    """The hit that stands for a group, by an ordered fold: more severe, else a firmer signal, else the lesser rule id.

    The last test applies even where the signal is the weaker one, so order matters.
    """

    def step(best: Column, x: Column) -> Column:
        return F.when(x["rank"] > best["rank"], x).when(x["rank"] < best["rank"], best).when(x["firm"] > best["firm"], x).when(x["rule_id"] < best["rule_id"], x).otherwise(best)

    return F.aggregate(F.slice(items, 2, F.size(items)), F.get(items, F.lit(0)), step)


def _first_of(items: Column, best: Column, field: str, empty) -> Column:
    """The primary hit's value, else the first there is."""
    other = F.get(F.filter(items, lambda x: x[field] != empty), F.lit(0))[field]
    return F.when(best[field] != empty, best[field]).otherwise(F.coalesce(other, F.lit(empty)))


_POLICY = ["scripts/", "preferences/", "policies/"]
_WORDS = ["deploy", "admin", "vpn", "customer", "hr", "finance", "payroll", "export", "backup", "token", "password", "secret", "settings", "config"]


@X.untraced
def correlate(raw: DataFrame) -> DataFrame:
    """One finding for each host, share, path and category, from all its raw hits.

    Weights add up by signal type and are capped; several types, and some tags
    together, add to the score. Context of path, share and plan counts where
    content was found, or where the category doesn't speak of mere files.
    """
    raw = cut(raw_severity(raw))
    signal = F.col("signal_type")
    firm = F.when(signal == "validated", 4).when(signal == "content", 3).when(signal == "filename", 2).when(signal == "extension", 1).otherwise(0)
    item = F.struct("seq", "rule_id", "severity", X.severity_rank(F.col("severity")).alias("rank"), firm.alias("firm"), "signal_type", "weight", "path_weight", "match", "line", "context", "account", "tags", F.col("confidence").alias("rule_confidence"), F.col("category").alias("cat"), F.col("file_path").alias("fp"))
    keys = [X.norm(F.col(c)).alias(f"k_{c}") for c in ("host", "share", "file_path", "category")]
    meta = [F.first(c).alias(c) for c in FILE if c not in ("file_path",)]
    g = raw.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), *meta)
    g = X.once(g, best=primary(F.col("items")))
    items, best = F.col("items"), F.col("best")
    tags = F.array_distinct(F.flatten(F.transform(items, lambda x: x["tags"])))
    g = g.withColumns({"tags": X.unique_sorted(tags), "types0": F.transform(items, lambda x: x["signal_type"])})
    has = lambda t: F.array_contains(F.col("tags"), t)
    strong = F.exists(F.col("types0"), lambda t: t.isin("content", "validated"))
    cat = F.col("k_category")
    boosts = F.when(strong, (cat != "database-artifacts") | has("db:type:dump-export")).otherwise(~cat.isin("configuration", "infrastructure", "scripts", "database-artifacts"))
    path = F.lower(F.replace(best["fp"], F.lit("\\"), F.lit("/")))
    share = F.when(F.col("from_sysvol"), 12).when(F.col("from_netlogon") | (F.col("share_priority") >= 90), 10).when(F.col("share_priority") >= 50, 6).otherwise(0)
    plan = F.when(F.col("priority") >= 120, 14).when(F.col("priority") >= 80, 12).when(F.col("priority") >= 40, 6).otherwise(0)
    g = g.withColumns({"boosts": boosts, "w_share": F.when(boosts, share).otherwise(0), "w_plan": F.when(boosts, plan).otherwise(0), "w_place": F.when(boosts & X.contains_any(path, _POLICY + _WORDS), 12).otherwise(0)})
    total = lambda t: F.aggregate(F.filter(items, lambda x: x["signal_type"] == t), F.lit(0), lambda n, x: n + x["weight"])
    own_path = F.aggregate(items, F.lit(0), lambda n, x: n + x["path_weight"])
    sums = {t: total(t) for t in TYPES[:4]} | {"path": own_path + F.col("w_place"), "share_priority": F.col("w_share"), "planner_priority": F.col("w_plan")}
    g = g.withColumns({f"s_{t}": F.least(v, F.lit(CAPS[t])) for t, v in sums.items()})
    distinct = sum(((F.col(f"s_{t}") > 0).cast("int") for t in TYPES[1:]), (F.col("s_validated") > 0).cast("int"))
    g = g.withColumn("n_types", distinct)
    spread = F.when(F.col("n_types") >= 4, 18).when(F.col("n_types") == 3, 14).when(F.col("n_types") == 2, 8).otherwise(0)
    together = (
        F.when(has("artifact:private-key") & has("validated:private-key-header"), 8).otherwise(0) + F.when(has("credstore:path-exact"), 10).otherwise(0)
        + F.when(has("artifact:aws-credentials") & (has("aws:type:bundle") | has("aws:type:session-bundle")), 10).otherwise(0) + F.when(has("artifact:backup-family"), 10).otherwise(0)
    )
    g = g.withColumn("correlation_score", spread + together)
    base = sum((F.col(f"s_{t}") for t in TYPES[1:]), F.col("s_validated")) + F.col("correlation_score")
    most = F.aggregate(items, best, lambda acc, x: F.when(x["rank"] > acc["rank"], x).otherwise(acc))["severity"]
    names = F.array_compact(F.array(*[F.when(F.col(f"s_{t}") > 0, t) for t in TYPES]))
    g = g.select(
        *[c for c in FILE if c != "file_path"], best["fp"].alias("file_path"), best["cat"].alias("category"), best["rule_id"].alias("rule_id"), most.alias("severity"), F.least(base, F.lit(100)).alias("base_score"),
        X.unique_sorted(F.transform(items, lambda x: x["rule_id"])).alias("matched_rule_ids"), names.alias("matched_signal_types"), _first_of(items, best, "signal_type", "").alias("signal_type"),
        _first_of(items, best, "match", "").alias("match"), _first_of(items, best, "context", "").alias("context"), _first_of(items, best, "account", "").alias("account"), _first_of(items, best, "line", 0).alias("line"),
        best["rule_confidence"].alias("rule_confidence"), "tags", (F.col("s_content") + F.col("s_validated")).alias("content_score"), (F.col("s_filename") + F.col("s_extension")).alias("heuristic_score"),
        (F.col("s_path") + F.col("s_share_priority") + F.col("s_planner_priority")).alias("path_score"), "correlation_score",
    )
    g = cut(g)
    blob = F.coalesce(*[F.when(X.strip(F.col(c)) != "", F.col(c)) for c in ("context", "match")], F.lit(""))
    g = X.once(g, quality=X.let(blob, lambda b: finding_quality(F.col("matched_signal_types"), F.col("category"), b)))
    g = g.withColumns({"strong": strong_evidence(F.col("rule_id"), F.col("signal_type"), F.col("quality")), "confidence_score": F.col("base_score"), "confidence": level(F.col("base_score"))})
    g = g.withColumn("correlated", (F.size("matched_signal_types") > 1) | (F.size("matched_rule_ids") > 1))
    return lower_visibility(triage(g).drop("strong"))


def lower_visibility(rows: DataFrame) -> DataFrame:
    """Stores of cloud and browser credentials without the credentials themselves are only context."""
    rule = X.norm(F.col("rule_id"))
    only = rule.isin("awsinspect.path.config", "awsinspect.path.credentials") | (rule.startswith("browsercredinspect.") & (F.col("signal_type") != "correlation"))
    return rows.withColumns(
        {
            "triage_class": F.when(only, "weak-review").otherwise(F.col("triage_class")), "actionable": F.col("actionable") & ~only, "correlated": F.col("correlated") & ~only,
            "severity": F.when(only & (X.severity_rank(F.col("severity")) > 2), "medium").otherwise(F.col("severity")),
            "confidence_score": F.when(only, F.least("confidence_score", F.lit(34))).otherwise(F.col("confidence_score")),
            "confidence": F.when(only & (X.confidence_rank(F.col("confidence")) > 2), "medium").otherwise(F.col("confidence")),
        }
    )


def visible(rows: DataFrame) -> DataFrame:
    """Findings that are shown as they come: actionable, and no mere support."""
    return rows.where(F.col("actionable") & ~F.col("rule_id").isin(*SUPPORTING))


@X.untraced
def evaluate(files: DataFrame, rules: list[dict], limits: gating.Limits = gating.Limits()) -> DataFrame:
    """Findings of a table of files, from gate to score."""
    return correlate(raw_findings(planned(files), rules, limits))
