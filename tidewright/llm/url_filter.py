"""URL filters with redirect equivalence, in DataFrame operations alone.

Explicit rules judge urls. Redirects and canonical links join urls into classes of aliases (connected components);
a block reaches the aliases of a blocked url, unless a rule allows them or any member of their class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains, where the path starts with its path."""

    verdict: str
    host: str
    path: str


#: Fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.contains(u, F.lit("://")), F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null without one. Of rules of equal length an allowing one wins."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def node_of(url: Column) -> Column:
    """A url's node: host, path and query without scheme, fragment and closing slash; null without a host."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^#]*", 0)
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    node = F.concat(ascii_lower(host), F.rtrim(F.substr(rest, F.length(host) + 1), F.lit("/")))
    return F.when(host != "", node)


#: What holds no links of the page itself: comments, and elements whose content is not markup.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
#: Named character references that may stand for characters of a url; that of & itself comes last, so
#: that nothing is decoded twice.
_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def _decoded(c: Column) -> Column:
    """Numeric references of ASCII characters, and those named above, decoded."""
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(&#(?:0*[0-9]{1,3}|x0*[0-7]?[0-9a-f]);?)")))
    number = lambda x: F.coalesce(F.conv(F.nullif(F.regexp_extract(x, r"(?i)^&#x([0-9a-f]+)", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(x, r"^&#([0-9]+)", 1), F.lit(""))).cast("long")
    # That of & itself waits for the named one.
    plain = lambda acc, x: F.when(number(x) == 38, F.replace(acc, x, F.lit("&amp;"))).when(number(x).between(1, 127), F.replace(acc, x, F.char(number(x)))).otherwise(acc)
    out = F.aggregate(codes, c, plain)
    for name, value in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag without its quotes; empty without it."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(_decoded(F.regexp_replace(value, r"^[\"']|[\"']$", "")))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b[^>]*>)"))


def canonical_of(html: Column) -> Column:
    """The target of the first canonical link; null without one."""
    named = F.filter(_tags(html, "link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical") & (_attribute(t, "href") != ""))
    return _attribute(F.get(named, F.lit(0)), "href")


_AT_ONCE = r"(?is)^0*(?:\.0*)?\s*[;,\s]\s*(?:url\s*=\s*)?(?:\"([^\"]*)\"?|'([^']*)'?|([^\"'].*))$"


def redirect_of(html: Column) -> Column:
    """The target of the first refresh without delay, null without one: `0`, then `;` or `,`, then the url, perhaps
    after `url=` and in quotes."""
    content = F.transform(F.filter(_tags(html, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: _attribute(t, "content"))
    value = F.get(F.filter(content, lambda c: F.regexp_like(c, F.lit(_AT_ONCE))), F.lit(0))
    return F.trim(F.concat(*(F.regexp_extract(value, _AT_ONCE, k) for k in (1, 2, 3))))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an absolute url, seen from the page at `base`; null for other schemes than http and https."""
    root = F.concat(F.lit("http://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    relative = F.concat(F.when(folder == "", "/").otherwise(folder), target)
    path, rest = F.regexp_extract(relative, r"(?s)^[^?#]*", 0), F.regexp_extract(relative, r"(?s)^[^?#]*(.*)$", 1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    steps = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), step)
    return (
        F.when(F.regexp_like(target, F.lit(r"(?i)^https?://")), target)
        .when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path_of(base), target))
        .when((target == "") | F.startswith(target, F.lit("#")), base)
        .otherwise(F.concat(root, F.lit("/"), F.array_join(steps, "/"), rest))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) nodes of each page and of the url that it names canonical or redirects to at once.

    Targets are decoded and resolved against the page's base element, if it has one, or else its url. Comments and the
    insides of scripts and the like are not read. A `>` inside an attribute ends its tag.
    """
    # Most pages have neither, and are told by a search for two words.
    likely = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.regexp_like("html", F.lit("(?i)canonical|http-equiv")))
    read = likely.select("url", F.regexp_replace("html", _UNREAD, " ").alias("html"))
    base = _attribute(F.get(_tags(F.col("html"), "base"), F.lit(0)), "href")
    based = read.withColumn("base", F.when(F.coalesce(base, F.lit("")) != "", resolved(F.col("url"), base)).otherwise(F.col("url")))
    found = based.select("url", "base", F.explode(F.array(canonical_of(F.col("html")), redirect_of(F.col("html")))).alias("to")).where("to <> ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("base"), F.col("to"))).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: host, path, the longest fitting rule, component and verdict.

    A page's own rule decides. Without one, a page is allowed if any url of its class of aliases has an allowing rule,
    blocked if one has a blocking rule, and allowed otherwise. Edges are the links in the pages themselves and
    `redirects` (from_url, to_url) if given.

    A null url, or one without ://, has neither host nor path, fits no rule, has no aliases, and is allowed. Null html
    names no aliases. Rows are judged one by one, so repeated pages get equal verdicts; an empty table gives no rows.
    Other columns are not read. A url of any length is taken whole.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    classes = components(edges)
    host = F.regexp_extract("node", r"^[^/?]*", 0)
    _, verdict = rule_of(host, F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules)
    # A closing slash that the node lacks may decide on a rule, so both forms are judged.
    _, slashed = rule_of(host, F.concat(F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), F.lit("/")), rules)
    judged = classes.withColumn("_v", F.coalesce(verdict, slashed)).groupBy("component").agg(F.bool_or(F.col("_v") == "allow").alias("_allow"), F.bool_or(F.col("_v") == "block").alias("_block"))
    aliases = written(classes.join(judged, "component").select(F.col("node").alias("_node"), "component", F.when(F.coalesce("_allow", F.lit(False)), "allow").when(F.coalesce("_block", F.lit(False)), "block").alias("_alias")))
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node_of(F.col(url_col)).alias("_node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_own", verdict)
    rows = rows.join(aliases, "_node", "left")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"), "component")
