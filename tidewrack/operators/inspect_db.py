"""Database artefacts and connection details, parsed from structure rather than key words.

Artefacts follow from names. Contents are taken apart by built-in functions: a
text becomes lines, lines become fragments, fragments maps of keys and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import quality as Q
from tidewrack.functions import text as X
from tidewrack.functions.regex import to_java
from tidewrack.operators.inspect_paths import match, present

FILES = {"tnsnames.ora": ("oracle_tnsnames", "oracle"), "sqlnet.ora": ("oracle_sqlnet", "oracle"), "odbc.ini": ("odbc_ini", "odbc"), "odbcinst.ini": ("odbcinst_ini", "odbc")}
EXTENSIONS = {
    ".udl": ("udl", "oledb"), ".dsn": ("odbc_dsn", "odbc"), ".mdb": ("access_mdb", "access"), ".accdb": ("access_accdb", "access"),
    ".db3": ("sqlite_db3", "sqlite"), ".sqlite": ("sqlite_db", "sqlite"), ".sqlite3": ("sqlite3_db", "sqlite"),
    ".dacpac": ("mssql_dacpac", "mssql"), ".bacpac": ("mssql_bacpac", "mssql"), ".ldf": ("mssql_ldf", "mssql"), ".ndf": ("mssql_ndf", "mssql"), ".mdf": ("mssql_mdf", "mssql"),
}
BACKUPS = {".dmp": "oracle", ".dump": "postgresql", ".bak": "mssql"}
_ENGINES = ["sqlite", "oracle", "postgres", "pgsql", "mysql", "mssql", "sql", "database"]
BACKUP_HINTS = ["backupset", "db-backup", "dbbackup", *_ENGINES]
HINTS = ["connection", "jdbc", "dsn", "odbc", *_ENGINES]
TEXTS = [".yml", ".yaml", ".xml", ".udl", ".txt", ".sql", ".properties", ".ora", ".json", ".ini", ".env", ".dsn", ".config", ".conf", ".cnf"]


def _tags(kind: str, ecosystem: Column | str, source: str = "local-artifact") -> Column:
    eco = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    return F.array(F.lit("database"), F.lit(f"db:source:{source}"), F.lit(f"db:type:{kind}"), F.concat(F.lit("db:ecosystem:"), eco))


def artifact_matches() -> Column:
    """Artefacts by exact name, by extension, and backups whose name speaks of a database."""
    name, ext = X.norm(F.col("name")), F.lower("extension")
    out = [F.when(name == n, match(f"dbinspect.artifact.{i}", "filename", "medium", "database-artifacts", name, name, _tags("artifact", e))) for n, (i, e) in FILES.items()]
    out += [F.when(ext == x, match(f"dbinspect.artifact.{i}", "extension", "medium", "database-artifacts", ext, ext, _tags("artifact", e))) for x, (i, e) in EXTENSIONS.items()]
    for x, e in BACKUPS.items():
        stem = F.substring(name, F.lit(1), F.length(name) - len(x))
        out.append(F.when((ext == x) & X.contains_any(stem, BACKUP_HINTS), match("dbinspect.artifact.database_backup", "extension", "medium", "database-artifacts", ext, X.slashes(F.col("file_path")), _tags("backup-artifact", e))))
    return present(*out)


def needs_content() -> Column:
    name, ext = X.norm(F.col("name")), F.lower("extension")
    hinted = X.contains_any(F.lower("file_path"), HINTS) | X.contains_any(name, HINTS)
    return name.isin(*FILES) | ext.isin(".dsn", ".sql", ".udl", ".ora") | (ext.isin(*TEXTS) & hinted)


def sql_counts(text: Column) -> Column:
    """Numbers of the statements that a dump consists of."""
    patterns = {
        "creates": r"(?im)\bCREATE\s+TABLE\b", "inserts": r"(?im)\bINSERT\s+INTO\b", "drops": r"(?im)\bDROP\s+TABLE\s+IF\s+EXISTS\b",
        "copies": r"(?im)\bCOPY\s+[^;\r\n]+\s+FROM\s+stdin;", "locks": r"(?im)\bLOCK\s+TABLES\b", "unlocks": r"(?im)\bUNLOCK\s+TABLES\b",
    }
    return F.struct(*[F.regexp_count(text, F.lit(to_java(p))).alias(n) for n, p in patterns.items()])


def dump_matches(text: Column) -> Column:
    """Header and structure of an SQL dump."""
    c = sql_counts(text)
    sql = F.lower("extension") == ".sql"
    mysql, postgres = text.rlike(to_java(r"(?im)^--\s+MySQL dump\b")), text.rlike(to_java(r"(?im)^--\s+(?:Dumped by pg_dump|PostgreSQL database dump)\b"))
    locked = (c["locks"] > 0) & (c["unlocks"] > 0)
    dump = (c["copies"] > 0) | ((c["creates"] >= 2) & ((c["inserts"] >= 1) | (c["drops"] >= 1) | locked)) | ((c["inserts"] >= 2) & ((c["creates"] >= 1) | (c["drops"] >= 1) | locked)) | (c["inserts"] >= 3) | (c["creates"] >= 3)
    words = (("creates", "CREATE TABLE"), ("inserts", "INSERT INTO"), ("drops", "DROP TABLE IF EXISTS"), ("copies", "COPY ... FROM stdin"), ("locks", "LOCK TABLES"), ("unlocks", "UNLOCK TABLES"))
    found = F.concat_ws("; ", *[F.when(c[n] > 0, F.concat(F.lit(w + " x"), c[n].cast("string"))) for n, w in words])
    head = F.when(mysql, "MySQL dump header").otherwise("PostgreSQL dump header")
    raw = X.limit(X.strip(text), 320)
    return present(
        F.when(sql & (mysql | postgres), match("dbinspect.artifact.sql_dump_header", "content", "high", "database-artifacts", head, raw, _tags("dump-export", F.when(mysql, "mysql").otherwise("postgresql")), line=F.lit(1))),
        F.when(sql & dump, match("dbinspect.artifact.sql_dump_structure", "content", "high", "database-artifacts", found, raw, _tags("dump-export", "generic"), signal="content", confidence="medium", line=F.lit(1))),
    )


def unwrap(c: Column) -> Column:
    """Without white space and quotes around it."""
    return X.strip(F.regexp_replace(X.strip(c), "^[\"']+|[\"']+$", ""))


PLACEHOLDERS = [a + b for a in ("your_", "your-") for b in ("database", "server", "username", "password")] + [f"replace{s}{w}" for s in "_-" for w in ("this", "me")] + ["placeholder", "changeme"]


def meaningful(c: Column) -> Column:
    """The value without its wrapping, empty for a placeholder."""

    def judged(v: Column) -> Column:
        low = F.lower(v)
        bad = low.rlike("^(?:<.*>|\\$?\\{.*\\})$") | low.isin("dsn", "dbname", "database", "host", "server", "pwd", "password", "user", "username") | X.contains_any(low, PLACEHOLDERS)
        return F.when(bad, "").otherwise(v)

    return X.let(unwrap(F.coalesce(c, F.lit(""))), judged)


def pair(line: Column) -> Column:
    """Key and value at the first ``=``, else at the first ``:``; null without both."""
    cut = F.when((F.instr(line, "=") > 1) & (F.instr(line, "=") < F.length(line)), F.instr(line, "=")).when((F.instr(line, ":") > 1) & (F.instr(line, ":") < F.length(line)), F.instr(line, ":"))
    return F.when(cut.isNotNull(), F.struct(X.strip(F.substring(line, F.lit(1), cut - 1)).alias("k"), X.strip(F.substring(line, cut + 1, F.length(line))).alias("v")))


def key_name(k: Column) -> Column:
    """Keys without case, spaces, dashes and underscores; synonyms are one."""
    k = F.regexp_replace(X.norm(k), "[_ -]", "")
    return F.when(k.isin("dbq", "networkaddress", "address", "addr", "datasourcepath"), "datasource").when(k.isin("databasename", "initialcatalog"), "database").otherwise(k)


def last_of_each(pairs: Column) -> Column:
    """Map of pairs (structs ``k`` and ``v``); a later pair overwrites an earlier one of its key. Sorted once, not compared pair by pair."""
    at = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    last = X.let(at, lambda a: F.filter(a, lambda p, i: F.coalesce(F.get(a, i + 1)["k"] != p["k"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def connection_values(fragment: Column) -> Column:
    """Pairs of a string like ``a=b;c=d``."""
    parts = F.filter(F.transform(F.split(fragment, ";"), lambda p: pair(X.strip(p))), lambda p: p.isNotNull())
    return F.transform(parts, lambda p: F.struct(key_name(p["k"]).alias("k"), unwrap(p["v"]).alias("v")))


def first_value(values: Column, *keys: str) -> Column:
    """First of the keys that has a value, made meaningful."""
    found = F.coalesce(*[F.nullif(X.strip(values[k]), F.lit("")) for k in keys], F.lit(""))
    return meaningful(found)


def ecosystem(values: Column) -> Column:
    """Database product that keys and values speak of, empty if none."""
    every = F.lower(F.concat_ws(";", F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), e["value"])))))
    kinds = (
        ("mssql", ["sqlserver", "sqloledb", "mssql", "initialcatalog"]), ("mysql", ["mysql", ":3306"]), ("postgresql", ["postgres", "pgsql", ":5432"]),
        ("oracle", ["oracle", "oraoledb", ":1521", "servicename", "sid"]), ("sqlite", ["sqlite"]), ("access", [".accdb", ".mdb", "microsoft.ace.oledb", "microsoft.jet.oledb"]), ("odbc", ["dsn=", "driver=", "odbc"]),
    )
    return X.let(every, lambda flat: F.coalesce(*[F.when(X.contains_any(flat, parts), name) for name, parts in kinds], F.lit("")))


def url_values(fragment: Column) -> Column:
    """Pairs of a database URL, with or without ``jdbc:``; null if it is none."""
    user = "(?:([^/?#@:]*)(?::([^/?#@]*))?@)?"
    whole = f"^[A-Za-z][A-Za-z0-9+.-]*://{user}([^/?#:]*)(?::[0-9]*)?(/[^?#]*)?(?:\\?([^#]*))?"
    ora = "^(?i:jdbc:oracle:)[^@]+@(?://)?([^:/;]+)(?::([0-9]{2,5}))?/([A-Za-z0-9_.-]+)$"
    pairs = lambda *kv: F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v")) for k, v in kv])

    def of_url(plain: Column) -> Column:
        part = lambda i: F.regexp_extract(plain, whole, i)
        query = F.filter(F.transform(F.split(part(5), "&"), lambda p: F.struct(key_name(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
        scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return F.concat(pairs(("driver", scheme), ("server", part(3)), ("database", F.regexp_replace(part(4), "^/", "")), ("user", F.try_url_decode(part(1))), ("password", F.try_url_decode(part(2)))), query)

    def taken(low: Column) -> Column:
        plain = F.regexp_extract(fragment, "^(?i:jdbc:)?(.*)$", 1)
        server = F.regexp_extract(fragment, "^jdbc:sqlserver://([^;]*);", 1)
        mssql = F.concat(connection_values(F.regexp_extract(fragment, "^jdbc:sqlserver://[^;]*;(.*)$", 1)), pairs(("server", server)))
        sqlite = pairs(("driver", F.lit("sqlite")), ("database", F.regexp_extract(plain, "^[^:]*:/*(.*)$", 1)))
        got = lambda i: F.regexp_extract(fragment, ora, i)
        oracle = pairs(("driver", F.lit("oracle")), ("server", got(1)), ("port", got(2)), ("database", got(3)))
        jdbc = low.rlike("^jdbc:(?:mysql|postgresql)://")
        plain_url = low.rlike("^(?:postgres|postgresql|mysql)://") & (F.regexp_extract(plain, whole, 3) != "")
        return (
            F.when(low.startswith("jdbc:sqlserver://") & (meaningful(server) != ""), mssql).when(low.startswith("jdbc:sqlite:"), sqlite)
            .when(jdbc | plain_url, X.let(plain, of_url)).when(low.startswith("jdbc:oracle:") & (got(1) != ""), oracle)
        )

    return F.filter(X.let(F.lower(fragment), taken), lambda p: p["v"] != "")


def fragments(files: DataFrame) -> DataFrame:
    """Pieces of each line that may be connection strings: the line, a labelled value, quoted values."""
    text = F.col("text")  # most texts have none, so they aren't taken apart
    files = files.where((text.contains("=") & text.contains(";")) | text.contains("://") | F.lower(text).contains("jdbc:"))
    lines = files.select("*", F.posexplode(F.split("text", "\n")).alias("line0", "raw")).withColumn("raw", X.strip(F.col("raw")))
    lines = lines.where((F.col("raw").contains("=") & F.col("raw").contains(";")) | F.col("raw").contains("://") | F.lower("raw").contains("jdbc:"))
    p = pair(F.col("raw"))
    labelled = F.when(p.isNotNull() & X.contains_any(F.lower(p["k"]), ["jdbc", "dsn", "datasource", "connection"]), p["v"])
    quoted = F.concat(*[X.all_matches(F.col("raw"), f"{q}([^{q}\\r\\n]{{8,}}){q}", 1) for q in ('"', "'")])
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array_compact(F.array("raw", labelled)), quoted), unwrap), lambda f: F.octet_length(f) >= 8))
    return lines.drop("text").select("*", F.posexplode(every).alias("part", "fragment")).withColumn("line", F.col("line0") + 1).drop("line0", "raw")


def connections(files: DataFrame) -> DataFrame:
    """Connection strings and database URLs of all files, one row for each (rule, match) of a file: the first.

    Adds ``rule_id category severity match ecosystem line fragment user has_password``.
    """
    rows = fragments(files)
    has = F.col("fragment").contains("=") & F.col("fragment").contains(";")
    kinds = F.array(F.struct(F.lit(0).alias("by"), F.when(has, connection_values(F.col("fragment"))).alias("pairs")), F.struct(F.lit(1).alias("by"), url_values(F.col("fragment")).alias("pairs")))
    rows = rows.select("*", F.explode(kinds).alias("got")).select("*", "got.by", "got.pairs").drop("got").where(F.size("pairs") >= 2)
    rows = X.once(rows, values=last_of_each(F.col("pairs"))).drop("pairs")
    v = F.col("values")
    endpoint, database, driver = first_value(v, "server", "host", "datasource", "dsn"), first_value(v, "database", "dbname", "initialcatalog", "servicename", "sid"), first_value(v, "driver", "provider")
    user, password = first_value(v, "uid", "userid", "user", "username"), first_value(v, "password", "pwd")
    trusted = F.lower(F.coalesce(F.nullif(v["integratedsecurity"], F.lit("")), v["trustedconnection"], F.lit(""))).isin("1", "true", "yes", "sspi")
    rows = X.once(rows, endpoint=endpoint, database=database, driver=driver, user=user, password=password, trusted=trusted, known=ecosystem(v), named=F.coalesce(X.strip(v["driver"]), F.lit("")) != "").where("endpoint <> '' or database <> '' or driver <> ''")
    access = (F.col("user") != "") | (F.col("password") != "") | F.col("trusted")
    eco = F.when(F.col("known") != "", F.col("known")).when(F.col("named"), "odbc").otherwise("generic")
    rows = rows.withColumns(
        {
            "rule_id": F.when(access, "dbinspect.access.connection_string").otherwise("dbinspect.infrastructure.connection_string"),
            "category": F.when(access, "database-access").otherwise("database-infrastructure"),
            "severity": F.when(access & (F.col("password") != ""), "high").otherwise("medium"),
            "match": F.concat_ws(" -> ", *[F.when(F.col(c) != "", F.col(c)) for c in ("driver", "endpoint", "database")]),
            "ecosystem": eco, "has_password": F.col("password") != "",
        }
    )
    first = Window.partitionBy("file_id", "rule_id", F.lower("match")).orderBy("line", "part", "by")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "values", "part", "by", "endpoint", "database", "driver", "password", "trusted", "known", "named")


def sections(files: DataFrame) -> DataFrame:
    """DSN sections of INI files: ``rule_id category severity match ecosystem section`` for each that says where or who."""
    files = files.where(F.col("text").contains("[") & F.col("text").contains("]"))  # others have no head of a section
    rows = files.select("*", F.posexplode(F.split("text", "\n")).alias("at", "raw")).drop("text").withColumn("raw", X.strip(F.col("raw"))).where("raw <> '' and not raw rlike '^[;#]'")
    head = F.col("raw").rlike("^\\[.*\\]$")
    order = Window.partitionBy("file_id").orderBy("at")
    rows = rows.withColumn("number", F.sum(head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("number > 0")
    rows = rows.withColumn("p", F.when(~head, pair(F.col("raw"))))
    keys = [c for c in files.columns if c != "text"]
    entry = F.struct("at", key_name(F.col("p.k")).alias("k"), F.col("p.v").alias("v"))
    rows = rows.groupBy("file_id", "number").agg(*[F.first(c).alias(c) for c in keys if c != "file_id"], F.max(F.when(head, F.regexp_extract("raw", "^\\[(.*)\\]$", 1))).alias("section"), F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), entry))).alias("pairs"))
    rows = X.once(rows.where((F.size("pairs") > 0) & (F.trim("section") != "")), values=last_of_each(F.col("pairs")))
    v = F.col("values")
    got = {"driver": first_value(v, "driver", "provider"), "endpoint": first_value(v, "server", "host", "datasource"), "database": first_value(v, "database", "dbname"), "user": first_value(v, "uid", "userid", "user", "username"), "password": first_value(v, "password", "pwd")}
    rows = X.once(rows, known=ecosystem(v), **got)
    access = (F.col("user") != "") | (F.col("password") != "")
    rows = rows.where(access | (F.col("endpoint") != "") | (F.col("database") != ""))
    found = F.concat(F.trim("section"), F.when(F.col("endpoint") != "", F.concat(F.lit(" -> "), "endpoint")).otherwise(""), F.when(F.col("database") != "", F.concat(F.lit("/"), "database")).otherwise(""))
    rows = rows.withColumns(
        {
            "rule_id": F.when(access, "dbinspect.access.dsn").otherwise("dbinspect.infrastructure.dsn"), "category": F.when(access, "database-access").otherwise("database-infrastructure"),
            "severity": F.when(access, "high").otherwise("medium"), "match": found, "ecosystem": F.when(F.col("known") != "", F.col("known")).otherwise("odbc"),
        }
    )
    first = Window.partitionBy("file_id", "rule_id", F.lower("match")).orderBy("number")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(*keys, "rule_id", "category", "severity", "match", "ecosystem", "section")


def tns_services(files: DataFrame) -> DataFrame:
    """Services of Oracle's network files: ``alias host port service match line``."""
    rows = files.where((X.norm(F.col("name")) == "tnsnames.ora") | F.upper("text").contains("(DESCRIPTION="))
    alias = to_java(r"(?im)^\s*([\w.-]+)\s*=\s*\(DESCRIPTION\b")
    blocks = F.split("text", "(?=" + alias + ")")
    starts = F.transform(blocks, lambda b, i: F.struct(b.alias("block"), F.aggregate(F.slice(blocks, 1, i), F.lit(0), lambda n, x: n + F.length(x)).alias("at")))
    rows = rows.select("*", F.explode(starts).alias("b")).select("*", "b.block", (F.size(F.split(F.expr("substring(text, 1, b.at)"), "\n"))).alias("line")).drop("b", "text")
    get = lambda p: meaningful(F.regexp_extract("block", to_java(p), 1))
    service = F.coalesce(F.nullif(get(r"(?i)\bSERVICE_NAME\s*=\s*([^) \t\r\n]+)"), F.lit("")), get(r"(?i)\bSID\s*=\s*([^) \t\r\n]+)"))
    rows = X.once(rows, alias=F.regexp_extract("block", alias, 1), host_name=get(r"(?i)\bHOST\s*=\s*([^) \t\r\n]+)"), port=get(r"(?i)\bPORT\s*=\s*([0-9]{2,5})"), service=service)
    rows = rows.where("alias <> '' and host_name <> '' and service <> ''")
    found = F.concat("alias", F.lit(" -> "), "host_name", F.when(F.col("port") != "", F.concat(F.lit(":"), "port")).otherwise(""), F.lit("/"), "service")
    rows = rows.withColumn("match", found)
    first = Window.partitionBy("file_id", F.lower("match")).orderBy("line")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "block")


_SAMPLES = ["changeme", "placeholder", "replace_me", "replace-me", "example", "sample", "test"]
_ACCESS = ["connection", "dsn", "db_url", "database_url"]


def cell_findings(cells: DataFrame) -> DataFrame:
    """Findings in the cells of databases (``file_id table_name column_name row_number value``).

    A cell of a column that speaks of connections is taken apart like a line of
    settings; any other is a finding if its value looks usable. Adds ``rule_id
    category severity confidence match quality``; null and blank values give
    none, repeated cells one each, an empty table none.
    """
    name = X.norm(F.col("column_name"))
    where = F.concat_ws(".", "table_name", "column_name")
    spoken = X.contains_any(name, _ACCESS)
    low = F.lower(unwrap(F.col("value")))
    rows = X.once(cells.where(~spoken), q=Q.value_quality(F.col("value")))
    plain = rows.where(~F.col("q.weak") & ~X.contains_any(low, _SAMPLES)).select(
        "file_id", "table_name", "column_name", "row_number", F.lit("sqliteinspect.credentials.sensitive_value").alias("rule_id"), F.lit("credentials").alias("category"),
        F.when(F.col("q.strong"), "high").otherwise("medium").alias("severity"), F.when(F.col("q.strong"), "high").otherwise("medium").alias("confidence"), where.alias("match"), F.col("q.label").alias("quality"),
    )
    # each cell is a text of its own for the parser of connections
    texts = cells.where(spoken & F.col("value").isNotNull()).select(F.struct("file_id", "table_name", "column_name", "row_number").alias("file_id"), F.col("value").alias("text"))
    access = connections(texts).select(
        "file_id.*", F.lit("sqliteinspect.access.connection_string").alias("rule_id"), "category", "severity", F.lit("high").alias("confidence"), F.concat_ws(".", "file_id.table_name", "file_id.column_name").alias("match"), F.lit("high").alias("quality"),
    )
    return plain.unionByName(access)
