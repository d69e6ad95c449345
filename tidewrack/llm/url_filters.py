"""URL templates from a tree of path segments, and their labelled purity.

URLs are reduced to different (host, path) pairs with counts, and the trees of
all hosts are grown together, one level at a time, as deep as the deepest path.
Under a node, a segment with few URLs is variable and becomes a wildcard of its
class: ``{num}``, ``{hex}``, ``{word}`` or ``{mixed}``, with a file's extension
kept. Segments with enough URLs to judge are branches, however many there are;
those of a class whose continuations and labels don't differ significantly from
all branches' together are merged into the wildcard too. A template's purity is
its share of good labelled URLs, smoothed towards the share of all; impure
templates are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm._scratch import cut

#: Least URLs of a branch, too few of which can't be told from chance.
LEAST_URLS = 20
#: Greatest Jensen-Shannon divergence, in nats, and greatest z of label rates, of branches that merge.
DIVERGENCE, LEAST_Z = 0.02, 1.96
#: Weight of the prior in labelled URLs, and the least purity.
WEIGHT, PURITY = 10.0, 0.75

_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_FILE = "[.][A-Za-z0-9]{1,5}$"
KINDS = ("end", "num", "hex", "word", "mixed")


def _kind(segment: Column) -> Column:
    """Class of a segment without its extension; ``end`` for null."""
    bare = F.regexp_replace(segment, _FILE, "")
    return (
        F.when(segment.isNull(), "end").when(bare.rlike("^[0-9]+$"), "num").when(bare.rlike("^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$") & (F.length(bare) >= 8), "hex")
        .when(bare.rlike("[0-9%=]"), "mixed").otherwise("word")
    )


def _paths(pages: DataFrame, labels: DataFrame, page_col: str, url_col: str, id_col: str, label_col: str) -> DataFrame:
    """Different (host, path) pairs with ``n``, ``labelled`` and ``good``."""
    known = labels.select(labels[id_col].alias("page_id"), labels[label_col].cast("int").alias("label")).where("page_id is not null and label is not null").groupBy("page_id").agg(F.max("label").alias("label"))
    rows = pages.select(pages[page_col].alias("page_id"), _host(pages[url_col]).alias("host"), _path(pages[url_col]).alias("path")).join(known, "page_id", "left")
    return rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("good"))


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), _HOST, 2)), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), _PATH, 1), F.lit(""))


def _segment(level: int) -> Column:
    """Segment of a level, from 0; null beyond the end."""
    return F.get("segments", F.lit(level))


def _divergence(own: list[Column], all_: list[Column], n: Column, total: Column) -> Column:
    """Jensen-Shannon divergence of a branch's continuations from all branches'."""
    parts = F.lit(0.0)
    for a, b in zip(own, all_):
        p, q = a / n, b / total
        m = (p + q) / 2
        parts = parts + F.when(p > 0, p * F.log(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log(q / m)).otherwise(0.0) / 2
    return parts


def _branches(paths: DataFrame, level: int) -> DataFrame:
    """Segments that stay literal at a level: ``host``, ``template``, ``segment``."""
    nexts = _kind(_segment(level + 1))
    child = paths.where(_segment(level).isNotNull()).select("host", "template", _segment(level).alias("segment"), "n", "labelled", "good", nexts.alias("next"))
    sums = [F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    child = child.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), *sums)
    child = cut(child.where(F.col("n") >= LEAST_URLS).withColumn("kind", _kind(F.col("segment"))))
    # a node's branches are added up and joined back, so that a host with very many of them is no window in one task
    sums = ["n", "labelled", "good", *[f"n_{k}" for k in KINDS]]
    whole = child.groupBy("host", "template", "kind").agg(F.count("*").alias("siblings"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    child = child.join(whole, ["host", "template", "kind"])
    apart = _divergence([F.col(f"n_{k}") for k in KINDS], [F.col(f"all_n_{k}") for k in KINDS], F.col("n"), F.col("all_n"))
    lab, good = F.col("all_labelled"), F.col("all_good")
    rate = good / F.greatest(lab, F.lit(1))
    spread = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
    z = F.when(F.col("labelled") == 0, 0.0).otherwise(F.abs(F.col("good") / F.greatest(F.col("labelled"), F.lit(1)) - rate) / F.greatest(spread, F.lit(1e-9)))
    child = child.select("host", "template", "segment", "siblings", apart.alias("apart"), z.alias("z"))
    return child.where((F.col("siblings") == 1) | (F.col("apart") > DIVERGENCE) | (F.col("z") > LEAST_Z)).select("host", "template", "segment", F.lit(True).alias("stays"))


def templates(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Template of each (host, path): ``host``, ``path``, ``template``, ``n``, ``labelled``, ``good``."""
    paths = _paths(pages, labels, page_col, url_col, id_col, label_col)
    paths = cut(paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit("")))
    wild = lambda x: F.concat(F.lit("{"), _kind(x), F.lit("}"), F.lower(F.regexp_extract(x, _FILE, 0)))
    done, level = [], 0
    while True:
        # below a node of few URLs nothing can stay literal, so its paths are done at once, however deep
        deep = F.size("segments") > level
        large = paths.where(deep).groupBy("host", "template").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_URLS).select("host", "template", F.lit(True).alias("large"))
        paths = cut(paths.join(large, ["host", "template"], "left").withColumn("large", F.coalesce(F.col("large") & deep, F.lit(False))))
        rest = F.array_join(F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda x: F.concat(F.lit("/"), wild(x))), "")
        done.append(paths.where(~F.col("large")).select("host", "path", F.concat("template", rest).alias("template"), "n", "labelled", "good"))
        paths = paths.where("large").drop("large")
        if paths.isEmpty():
            break
        stays = _branches(paths, level)
        joined = paths.withColumn("segment", _segment(level)).join(stays, ["host", "template", "segment"], "left")
        step = F.concat(F.col("template"), F.lit("/"), F.when(F.col("stays"), F.col("segment")).otherwise(wild(F.col("segment"))))
        paths = joined.withColumn("template", step).select("host", "path", "n", "labelled", "good", "segments", "template")
        level += 1
    return reduce(DataFrame.union, done)


def judge(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", id_col: str = "doc_id", label_col: str = "quality", purity: float = PURITY) -> DataFrame:
    """Each page's template and whether it is kept.

    Columns: ``page_id``, ``host``, ``template``; ``n_urls``, ``n_labelled`` and
    ``n_good`` of the template; ``purity``; ``kept``. Labels belong to pages by
    id; above 0 is good, of several the greatest counts. Query and fragment
    are no part of a template, nor are empty segments. A URL that is null or
    has no scheme has an empty host and template, judged like any other. Null
    page ids have no label; repeated rows count each; without labels nothing
    is rejected; an empty table gives no rows.
    """
    paths = cut(templates(pages, labels, page_col, url_col, id_col, label_col))
    whole = paths.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).first()
    prior = whole["g"] / whole["l"] if whole["l"] else 1.0
    found = paths.groupBy("host", "template").agg(F.sum("n").alias("n_urls"), F.sum("labelled").alias("n_labelled"), F.sum("good").alias("n_good"))
    share = (F.col("n_good") + WEIGHT * prior) / (F.col("n_labelled") + WEIGHT)
    found = found.withColumn("purity", F.round(share, 6)).withColumn("kept", F.col("purity") >= purity)
    rows = pages.select(pages[page_col].alias("page_id"), _host(pages[url_col]).alias("host"), _path(pages[url_col]).alias("path"))
    rows = rows.join(paths.select("host", "path", "template"), ["host", "path"]).join(found, ["host", "template"])
    return rows.select("page_id", "host", "template", "n_urls", "n_labelled", "n_good", "purity", "kept")


def _sql(levels: int) -> str:
    """The same for DuckDB, with the levels unrolled."""
    kind = lambda s: (
        f"CASE WHEN {s} IS NULL THEN 'end' WHEN regexp_matches(regexp_replace({s}, '{_FILE}', ''), '^[0-9]+$') THEN 'num' "
        f"WHEN regexp_matches(regexp_replace({s}, '{_FILE}', ''), '^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$') AND length(regexp_replace({s}, '{_FILE}', '')) >= 8 THEN 'hex' "
        f"WHEN regexp_matches(regexp_replace({s}, '{_FILE}', ''), '[0-9%=]') THEN 'mixed' ELSE 'word' END"
    )
    out = [f"""
known AS (SELECT doc_id AS page_id, max(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
parsed AS (SELECT page_id, coalesce(lower(regexp_extract(url, '{_HOST}', 2)), '') AS host, coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path FROM pages),
t0 AS MATERIALIZED (
  SELECT host, path, '' AS template, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE label > 0) AS good,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY host, path
)"""]
    for k in range(levels):
        sums = ", ".join(f"sum(CASE WHEN nxt = '{x}' THEN n ELSE 0 END) AS n_{x}" for x in KINDS)
        window = "OVER (PARTITION BY host, template, kind)"
        term = lambda a, b: f"CASE WHEN {a} > 0 THEN ({a}) * ln(({a}) / ((({a}) + ({b})) / 2)) ELSE 0 END / 2"
        parts = " + ".join(f"{term(f'(n_{x} / n)', f'(sum(n_{x}) {window} / sum(n) {window})')} + {term(f'(sum(n_{x}) {window} / sum(n) {window})', f'(n_{x} / n)')}" for x in KINDS)
        rate = f"(sum(good) {window} / greatest(sum(labelled) {window}, 1))"
        out.append(f"""
c{k} AS (
  SELECT host, template, segments[{k + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good, {sums}
  FROM (SELECT *, {kind(f'segments[{k + 2}]')} AS nxt FROM t{k} WHERE len(segments) > {k}) GROUP BY 1, 2, 3
),
b{k} AS (SELECT *, {kind('segment')} AS kind FROM c{k} WHERE n >= {LEAST_URLS}),
s{k} AS MATERIALIZED (
  SELECT host, template, segment FROM (
    SELECT host, template, segment, count(*) {window} AS siblings, {parts} AS apart,
      CASE WHEN labelled = 0 THEN 0 ELSE abs(good / greatest(labelled, 1) - {rate}) / greatest(sqrt({rate} * (1 - {rate}) / greatest(labelled, 1)), 1e-9) END AS z
    FROM b{k}) WHERE siblings = 1 OR apart > {DIVERGENCE} OR z > {LEAST_Z}
),
t{k + 1} AS MATERIALIZED (
  SELECT t.host, t.path, CASE WHEN len(t.segments) <= {k} THEN t.template ELSE t.template || '/' || CASE WHEN s.segment IS NOT NULL THEN s.segment
    ELSE '{{' || {kind(f't.segments[{k + 1}]')} || '}}' || lower(regexp_extract(t.segments[{k + 1}], '{_FILE}')) END END AS template, n, labelled, good, segments
  FROM t{k} t LEFT JOIN s{k} s ON t.host = s.host AND t.template = s.template AND t.segments[{k + 1}] = s.segment
)""")
    return f"""WITH {','.join(out)},
named AS (SELECT host, path, template, n, labelled, good FROM t{levels} WHERE len(segments) <= {levels} OR error('a path is deeper than this query') IS NULL),
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / sum(labelled) ELSE 1.0 END AS prior FROM named),
found AS (
  SELECT host, template, CAST(sum(n) AS BIGINT) AS n_urls, CAST(sum(labelled) AS BIGINT) AS n_labelled, CAST(sum(good) AS BIGINT) AS n_good,
    round((sum(good) + {WEIGHT} * any_value(prior)) / (sum(labelled) + {WEIGHT}), 6) AS purity
  FROM named, prior GROUP BY 1, 2
)
SELECT page_id, host, template, n_urls, n_labelled, n_good, purity, purity >= {PURITY} AS kept
FROM parsed JOIN named USING (host, path) JOIN found USING (host, template)
"""


#: As many levels as SQL is written out for; the operator has no such bound, and a deeper path makes this query fail instead of agreeing by chance.
SQL = _sql(8)
