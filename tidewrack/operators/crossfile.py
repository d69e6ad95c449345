"""Findings of several files together: artefacts that complete each other in one place.

All eight kinds are conditional aggregates over host, share and context, so no
finding is joined with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import text as X
from tidewrack.operators import inspect_paths

COLUMNS = ("host", "share", "file_path", "rule_id", "category", "severity", "confidence", "confidence_score", "match", "context", "matched_rule_ids", "archive_path")


def _once(findings: DataFrame) -> DataFrame:
    """``findings`` with what the families ask of each, computed once for all of them."""
    plain = F.regexp_replace(F.col("file_path"), "(?:!|::).*$", "")
    values = {
        "path": inspect_paths.path(), "base": X.norm(X.base_name(F.col("file_path"))), "dir": X.norm(X.directory(F.col("file_path"))), "rule": X.norm(F.col("rule_id")), "archive": X.norm(F.col("archive_path")),
        "host": X.norm(F.col("host")), "share": X.norm(F.col("share")), "plain_base": X.norm(X.base_name(plain)), "plain_dir": X.norm(X.directory(plain)),
    }
    return X.once(findings, **{f"__{n}": v for n, v in values.items()})


def _base() -> Column:
    return F.col("__base")


def _path() -> Column:
    return F.col("__path")


def _directory() -> Column:
    """Archive, or directory of a file."""
    return F.when(F.col("archive_path") != "", F.col("__archive")).otherwise(F.col("__dir"))


def _access_directory() -> Column:
    """Directory of a file; a last segment that only numbers a tier doesn't count."""
    d = F.col("__dir")
    return F.when(d.rlike("/tier-?[0-9]+$"), X.directory(d)).otherwise(d)


def _get(anchors: Column, family: str) -> Column:
    return F.element_at(anchors, family)


def _has(anchors: Column, *families: str) -> Column:
    return reduce(Column.__and__, [_get(anchors, f).isNotNull() for f in families])


def _finding(rule: str, category: str, severity: Column, score: Column, first: Column, second: Column, match: Column) -> Column:
    """The finding that two anchors make together."""
    context = F.concat_ws("\n", F.lit("Paired artifact context:"), first["file_path"], second["file_path"])
    rules = X.unique_sorted(F.concat(first["matched_rule_ids"], F.coalesce(second["matched_rule_ids"], F.array().cast("array<string>")), F.array(F.lit(rule))))
    values = (first["host"], first["share"], first["file_path"], F.lit(rule), F.lit(category), severity, F.lit("high"), score.cast("int"), match, context, rules, first["archive_path"])
    return F.struct(*[v.alias(n) for n, v in zip(COLUMNS, values)])


def _ad() -> list[tuple[Column, Column, bool]]:
    family = F.when(_base().rlike("^ntds\\.dit(?:\\.(?:bak|old))?$"), "ntds").when(_base().rlike("^system(?:\\.(?:bak|old))?$"), "system")
    return [(family, _directory(), True)]


def _ad_pair(a: Column) -> Column:
    """A directory database beside the hive that opens it."""
    return F.when(_has(a, "ntds", "system"), _finding("correlation.ad.ntds_system", "credentials", F.lit("critical"), F.lit(82), _get(a, "ntds"), _get(a, "system"), F.lit("NTDS + SYSTEM")))


def _cloud() -> list[tuple[Column, Column, bool]]:
    rule = F.col("__rule")
    family = F.when(rule.isin("awsinspect.path.credentials", "awsinspect.content.credentials_bundle"), "credentials").when(rule == "awsinspect.path.config", "config")
    return [(family, inspect_paths.aws_profile(_path()), False)]


def _cloud_pair(a: Column) -> Column:
    """Credentials and settings of one cloud profile."""
    score = F.when(_get(a, "credentials")["rule_id"] == "awsinspect.content.credentials_bundle", 84).otherwise(78)
    return F.when(_has(a, "credentials", "config"), _finding("correlation.cloud.aws_profile_bundle", "credentials", F.lit("high"), score, _get(a, "credentials"), _get(a, "config"), F.lit("credentials + config")))


def _keys() -> list[tuple[Column, Column, bool]]:
    ext, rule = X.extension(_base()), F.col("__rule")
    family = (
        F.when(_base().isin(*inspect_paths.KEY_FILES), "private_key").when(_base().isin("authorized_keys", "known_hosts"), "ssh").when(ext.isin(".ovpn", ".ppk"), "client")
        .when(rule.isin("keyinspect.content.private_key_header", "filename.private_key_artifacts"), "private_key").when(rule == "filename.ssh_supporting_artifacts", "ssh").when(rule == "extension.client_auth_artifacts", "client")
    )
    return [(family, _access_directory(), True)]


def _key_bundle(a: Column) -> Column:
    """A private key beside what it logs in to."""
    client = _has(a, "client")
    match = F.when(client, "private key + client-auth artifact").otherwise("private key + SSH support")
    made = _finding("correlation.remote_access.private_key_bundle", "remote-access", F.when(client, "critical").otherwise("high"), F.when(client, 84).otherwise(76), _get(a, "private_key"), F.coalesce(_get(a, "client"), _get(a, "ssh")), match)
    return F.when(_has(a, "private_key") & (client | _has(a, "ssh")), made)


def _certificates() -> list[tuple[Column, Column, bool]]:
    rule = F.col("__rule")
    passwords = ("content.password_assignment_indicators", "content.password_note_value_indicators", "content.note_style_credential_pair_indicators")
    family = F.when(X.extension(_base()).isin(".pfx", ".p12") & (rule == "extension.key_and_certificate_extensions"), "certificate").when(rule.isin(*passwords), "password")
    return [(family, _access_directory(), True)]


def _certificate_bundle(a: Column) -> Column:
    """A certificate with its key beside a password."""
    return F.when(_has(a, "certificate", "password"), _finding("correlation.remote_access.certificate_bundle", "remote-access", F.lit("critical"), F.lit(82), _get(a, "certificate"), _get(a, "password"), F.lit("certificate + password evidence")))


def _browsers() -> list[tuple[Column, Column, bool]]:
    family = F.when(F.col("rule_id").startswith("browsercredinspect."), F.replace(F.regexp_extract("rule_id", "^browsercredinspect\\.(.*)$", 1), F.lit("."), F.lit("_")))
    return [(family, inspect_paths.browser_profile(_path()), False)]


def _browser_pair(a: Column) -> Column:
    """Both halves of a browser's credential store in one profile; Firefox counts before Chromium."""
    fire = _has(a, "firefox_logins", "firefox_key4")
    pick = lambda x, y: F.when(fire, _get(a, x)).otherwise(_get(a, y))
    match = F.when(fire, "Firefox logins + key4").otherwise("Chromium Login Data + Cookies")
    made = _finding("correlation.browser.profile_credential_store", "browser-credentials", F.when(fire, "critical").otherwise("high"), F.when(fire, 84).otherwise(78), pick("firefox_logins", "chromium_login_data"), pick("firefox_key4", "chromium_cookies"), match)
    return F.when(fire | _has(a, "chromium_login_data", "chromium_cookies"), made)


def _dpapi() -> list[tuple[Column, Column, bool]]:
    return [(F.when(F.col("rule_id").startswith("wincredinspect.path."), F.regexp_extract("rule_id", "([a-z]+)$", 1)), inspect_paths.windows_profile(_path()), False)]


def _dpapi_pair(a: Column) -> Column:
    """A profile's protected credentials with the keys that open them."""
    match = F.concat_ws(" + ", F.when(_has(a, "credentials"), "Credentials"), F.when(_has(a, "vault"), "Vault"), F.lit("Protect"))
    made = _finding("correlation.windows.dpapi_credential_store", "windows-credentials", F.lit("critical"), F.when(_has(a, "credentials", "vault"), 88).otherwise(84), F.coalesce(_get(a, "credentials"), _get(a, "vault")), _get(a, "protect"), match)
    return F.when(_has(a, "protect") & (_has(a, "credentials") | _has(a, "vault")), made)


_STORES = ("ntds", "sam", "system", "security")


def _backups() -> list[tuple[Column, Column, bool]]:
    artifact = F.regexp_extract(_base(), "^(ntds|system|sam|security)(?:\\.dit)?(?:\\.(?:bak|old))?$", 1)
    exact = _base().rlike("^(?:ntds\\.dit|system|sam|security)(?:\\.(?:bak|old))?$")
    context = inspect_paths.backup_context(_path())
    return [(F.when(exact, artifact), context, False), (F.when(F.col("rule_id").startswith("backupinspect.path."), "place"), context, False)]


def _backup_set(a: Column) -> Column:
    """Two or more secret stores of a system in one backup; its path, where detected, adds to the score."""
    rank = lambda x: F.struct((-x["confidence_score"]).alias("s"), (-X.severity_rank(x["severity"])).alias("r"), x["file_path"].alias("p"), x.alias("a"))
    best = F.array_sort(F.transform(F.array_compact(F.array(*[_get(a, s) for s in _STORES])), rank))
    match = F.concat_ws(" + ", *[F.when(_has(a, s), s.upper()) for s in _STORES])
    made = _finding("correlation.backup.system_state_exposure", "backup-exposure", F.lit("critical"), F.when(_has(a, "place"), 86).otherwise(82), F.get(best, F.lit(0))["a"], F.get(best, F.lit(1))["a"], match)
    return F.when(reduce(Column.__add__, [_has(a, s).cast("int") for s in _STORES]) >= 2, made)


def _databases() -> list[tuple[Column, Column, bool]]:
    name = F.col("__plain_base")
    support = name.isin(".env", "appsettings.json", "web.config", "docker-compose.yml") | X.extension(name).isin(".bak", ".sql", ".dump") | F.col("rule_id").isin("dbinspect.access.connection_string", "dbinspect.access.dsn", "dbinspect.artifact.database_backup")
    return [(F.when(F.col("rule_id").startswith("sqliteinspect."), "sqlite").when(support, "support"), F.col("__plain_dir"), True)]


def _database_support(a: Column) -> Column:
    """A secret found in a database's rows beside settings or backups that make it usable."""
    return F.when(_has(a, "sqlite", "support"), _finding("correlation.database.sqlite_exposure", "database-access", F.lit("high"), F.lit(80), _get(a, "sqlite"), _get(a, "support"), F.lit("SQLite row evidence + support artifact")))


#: Kind: the families that a finding belongs to, in which context, and whether host and share must be known; then what the anchors make.
KINDS = {
    "ad": (_ad, _ad_pair), "cloud": (_cloud, _cloud_pair), "keys": (_keys, _key_bundle), "certificates": (_certificates, _certificate_bundle),
    "browsers": (_browsers, _browser_pair), "dpapi": (_dpapi, _dpapi_pair), "backups": (_backups, _backup_set), "databases": (_databases, _database_support),
}


_THERE = "there"


@X.untraced
def anchors(findings: DataFrame) -> DataFrame:
    """One row for each kind, host, share and context: a map of its families' anchors.

    An anchor has the greatest score of its family, then severity, then the
    least path and rule. All kinds share one pass over the findings and one
    shuffle of those that are in a family at all. Findings that followed from
    others before are a kind of their own, by exact place and rule.
    """
    roles = []
    for kind, (of, _) in KINDS.items():
        for family, context, full in of():
            known = (F.col("__host") != "") & (F.col("__share") != "") if full else F.lit(True)
            roles.append(F.when(family.isNotNull() & known, F.struct(F.lit(kind).alias("kind"), family.alias("family"), context.alias("ctx"))))
    place = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in ("host", "share", "file_path")])  # null where a part is: such a place meets none
    roles.append(F.when(F.col("rule_id").startswith("correlation."), F.struct(F.lit(_THERE).alias("kind"), F.col("rule_id").alias("family"), place.alias("ctx"))))
    rows = X.once(_once(findings), __roles=X.aside(F.array_compact(F.array(*roles)))).select(*COLUMNS, "__host", "__share", F.explode("__roles").alias("role"))
    rows = rows.select(*COLUMNS, F.col("__host").alias("k_host"), F.col("__share").alias("k_share"), "role.*").where("ctx <> ''")
    keys = ["kind", "k_host", "k_share", "ctx"]
    order = Window.partitionBy(*keys, "family").orderBy(F.col("confidence_score").desc(), X.severity_rank(F.col("severity")).desc(), "file_path", "rule_id")
    keep = F.struct("host", "share", "file_path", "rule_id", "confidence_score", "severity", "matched_rule_ids", "archive_path")
    rows = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", keep.alias("anchor")))).alias("anchors"))


@X.untraced
def correlated(findings: DataFrame) -> DataFrame:
    """The findings that follow from several others; where a place has one of the rule already, none is added.

    The findings are gone through once: those that are there already come with the anchors.
    """
    rows = findings if "archive_path" in findings.columns else findings.withColumn("archive_path", F.lit(""))
    made = F.coalesce(*[F.when(F.col("kind") == kind, make(F.col("anchors"))) for kind, (_, make) in KINDS.items()])
    found = X.once(anchors(rows), f=X.aside(made))
    keys = ("host", "share", "file_path", "rule_id")
    new = F.array_compact(F.array(F.when(F.col("f").isNotNull(), F.struct(*[F.col(f"f.{k}").alias(k) for k in keys], F.col("f").alias("f")))))
    there = F.transform(F.map_values("anchors"), lambda a: F.struct(*[a[k].alias(k) for k in keys], F.lit(None).alias("f")))
    each = found.select(F.explode(F.when(F.col("kind") == _THERE, there).otherwise(new)).alias("x")).select("x.*")
    g = each.groupBy(*keys).agg(F.collect_list("f").alias("new"), F.bool_or(F.col("f").isNull()).alias("there"))
    return g.where("not there").select(F.explode("new").alias("f")).select("f.*").select(*COLUMNS)


@X.untraced
def exposure_paths(found: DataFrame, top: int | None = None) -> DataFrame:
    """Correlated findings as ways in, ranked by how exploitable they are; ``top`` cuts the list.

    Columns: ``rank score tier path_type completeness host share file_path rule_id severity n_related``.
    """
    rule, match, context = X.norm(F.col("rule_id")), F.lower("match"), F.lower("context")
    is_ = lambda r: rule == f"correlation.{r}"
    ntds_system = match.contains("ntds") & match.contains("system")
    families = sum((match.contains(w).cast("int") for w in ("system", "sam", "security")), match.contains("ntds").cast("int"))
    every = match.contains("credentials") & match.contains("vault") & match.contains("protect")
    app = X.contains_any(context, [".env", "appsettings.json", "web.config", "docker-compose.yml"])
    kind = lambda t, s, c: F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(c).alias("c"))
    known = (
        F.when(is_("ad.ntds_system"), kind("ad-compromise-path", 95, "complete")).when(is_("cloud.aws_profile_bundle"), kind("cloud-credential-path", 88, "paired"))
        .when(is_("windows.dpapi_credential_store"), F.when(every, kind("windows-credential-store-exposure", 88, "complete")).otherwise(kind("windows-credential-store-exposure", 84, "paired")))
        .when(is_("remote_access.private_key_bundle"), F.when(match.contains("client-auth"), kind("vpn-client-auth-access-path", 86, "complete")).otherwise(kind("ssh-access-path", 78, "paired")))
        .when(is_("remote_access.certificate_bundle"), kind("certificate-client-auth-path", 88, "paired"))
        .when(is_("browser.profile_credential_store"), F.when(match.contains("firefox"), kind("browser-credential-store-exposure", 76, "paired")).otherwise(kind("browser-credential-store-exposure", 72, "paired")))
        .when(is_("database.sqlite_exposure"), F.when(app, kind("application-credential-path", 80, "paired")).otherwise(kind("database-access-path", 78, "paired")))
        .when(is_("backup.system_state_exposure"), F.when(ntds_system, kind("backup-exposure-path", 92, "complete")).when(families >= 3, kind("backup-exposure-path", 90, "multi-artifact")).otherwise(kind("backup-exposure-path", 88, "paired")))
    )
    rows = found.withColumn("__k", known).where("__k is not null")
    archived = X.strip(F.col("archive_path")) != ""
    bonus = F.when(F.col("__k.c") == "complete", 4).when(F.col("__k.c") == "multi-artifact", 6).otherwise(2)
    rows = rows.withColumns({"score": F.least(F.col("__k.s") + bonus + F.when(archived, 2).otherwise(0), F.lit(100)), "completeness": F.col("__k.c"), "base_type": F.when(archived, F.col("__k.t")).otherwise(""), "path_type": F.when(archived, "archive-derived-credential-cluster").otherwise(F.col("__k.t")), "n_related": F.size(F.split("context", "\n")) - 1})
    rows = rows.withColumn("tier", F.when(F.col("score") >= 90, "high").when(F.col("score") >= 75, "medium").otherwise("low"))
    order = [F.col("score").desc(), X.severity_rank(F.col("severity")).desc(), F.col("n_related").desc(), "host", "share", "file_path", "rule_id"]
    if top is not None:
        rows = rows.orderBy(*order).limit(top)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row for a way in, so few of them
    return rows.select("rank", "score", "tier", "path_type", "base_type", "completeness", "host", "share", "file_path", "rule_id", "severity", "n_related")
