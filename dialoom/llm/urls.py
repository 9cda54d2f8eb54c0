"""URL filters over redirect equivalence, with DataFrame operations only.

A page's own rule decides it: the longest rule whose host is the page's host or a parent domain and whose path begins the
page's path. Pages without a rule take what their aliases have: pages and link targets are nodes, canonical links and
meta-refresh redirects (and a given redirect table) are edges, and the connected components of that graph are classes of
aliases. A class with a blocked node blocks its undecided pages, unless the class also has an explicitly allowed node:
allow takes precedence. Everything else is allowed.

A node is a url without scheme and fragment, with its host in lower case, its dot segments resolved, and a path of at least
"/". A link's target is resolved against its page: absolute, without scheme, from the root, query or fragment only, or
relative; ampersands written as entities are read as such. Defined results: a null url, or one without
"://", has empty host and path, fits no rule, has no aliases and is allowed; null html has no links; repeated rows are
each judged; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components
from dialoom.llm.shared import Scratch, lower_ascii, table

#: The contract's rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: How an ampersand may be written in an attribute.
AMPERSAND = "&amp;|&#38;|&#x26;"
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; .. at the root stays there. The fold is per path, over its own segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(F.lit("")), step)
    whole = F.concat(F.array_join(folded, "/"), F.when(last.isin(".", "..") | (F.size(folded) == 1), "/").otherwise(""))
    return F.when(path == "", "/").when(path.contains("/."), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """Null where there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, without_dots(path_of(url)), F.regexp_extract(url, PARTS, 3)))


def rule_fits(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _absolute(url: Column, target: Column) -> Column:
    scheme_host = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    target = F.regexp_replace(target, AMPERSAND, "&")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(scheme_host, target))
        .when(target.startswith("#"), url)
        .when(target.startswith("?"), F.concat(scheme_host, path_of(url), target))
        .otherwise(F.concat(scheme_host, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """(u, v): nodes that a canonical link or a meta refresh makes one."""
    linked = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    found = linked.select(
        "url",
        F.explode(F.concat(
            F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1)),
            F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1)),
        )).alias("target"),
    ).where("target <> ''")
    return found.select(node_of(F.col("url")).alias("u"), node_of(_absolute(F.col("url"), F.col("target"))).alias("v")).dropna()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; redirects: (from_url, to_url), if there are any."""
    scratch = Scratch(pages.sparkSession, "urls")
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")).dropna())
    classes = connected_components(scratch, edges)
    node_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = classes.withColumn("verdict", rule_fits(host_of(node_url), path_of(node_url), rules)[1])
    blocked = ruled.groupBy("component").agg(F.max((F.col("verdict") == "block").cast("int")).alias("b"), F.max((F.col("verdict") == "allow").cast("int")).alias("a"))
    blocked = blocked.where("b = 1 AND coalesce(a, 0) = 0").select(F.col("component").alias("bad"))
    aliases = classes.join(blocked, F.col("component") == F.col("bad"), "left_semi").select("node")
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("own"))
    rule, verdict = rule_fits(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict})
    method = F.when(F.col("node").isNotNull(), "block").otherwise("allow")
    return parsed.join(aliases, F.col("own") == F.col("node"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict")
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)(\\??[^#]*)"
_RULE_CASES = [(what, domain, start) for what, domain, start in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]


def _cases(host: str, path: str, say) -> str:
    return "CASE " + " ".join(f"WHEN ({host} = '{d}' OR ends_with({host}, '.{d}')) AND starts_with({path}, '{s}') THEN '{say(w, d, s)}'" for w, d, s in _RULE_CASES) + " END"


def _host(x: str) -> str:
    return f"coalesce(translate(regexp_extract({x}, '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(x: str) -> str:
    return f"coalesce(regexp_extract({x}, '{_PARTS}', 2), '')"


def _node(x: str) -> str:
    return f"CASE WHEN {_host(x)} <> '' THEN {_host(x)} || {_without_dots(_path(x))} || regexp_extract({x}, '{_PARTS}', 3) END"


def _without_dots(path: str) -> str:
    segments = f"list_prepend([''], list_transform(string_split({path}, '/')[2:], lambda s: [s]))"
    folded = f"list_reduce({segments}, lambda kept, x: CASE WHEN x[1] = '..' THEN kept[1:greatest(len(kept) - 1, 1)] WHEN x[1] = '.' THEN kept ELSE list_concat(kept, x) END)"
    ends = f"CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') OR len({folded}) = 1 THEN '/' ELSE '' END"
    return f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN array_to_string({folded}, '/') || {ends} ELSE {path} END"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH RECURSIVE found AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '{_sql(CANONICAL)}'), lambda tag: regexp_extract(tag, '{_sql(HREF)}', 1)),
    list_transform(regexp_extract_all(html, '{_sql(REFRESH)}'), lambda tag: regexp_extract(tag, '{_sql(REFRESH_URL)}', 1)))) AS target
  FROM pages),
decoded AS (SELECT url, regexp_replace(target, '{AMPERSAND}', '&', 'g') AS target FROM found WHERE target <> ''),
resolved AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    WHEN starts_with(target, '#') THEN url
    WHEN starts_with(target, '?') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || {_path("url")} || target
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_replace({_path("url")}, '[^/]*$', ''), ''), '/') || target END AS target
  FROM decoded),
edges AS (SELECT {_node("url")} AS u, {_node("target")} AS v FROM resolved),
links AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM links UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u),
ruled AS (SELECT a, {_cases(_host("'x://' || b"), _path("'x://' || b"), lambda w, d, s: w)} AS verdict FROM reach),
bad AS (SELECT a FROM ruled GROUP BY a HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)),
parsed AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS own FROM pages)
SELECT page_id, host, path, {_cases("host", "path", lambda w, d, s: d + s)} AS rule,
  coalesce({_cases("host", "path", lambda w, d, s: w)}, CASE WHEN own IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed
"""
