"""The operators that SQL expresses, in DuckDB SQL over the same tables."""

from __future__ import annotations

from .url_filter import RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination(width: int = 10) -> str:
    return f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), {width}) AS n, array_to_string(w[i : i + least(len(w), {width}) - 1], ' ') AS body
            FROM items, unnest(range(1, greatest(len(w) - {width} + 1, least(len(w), 1)) + 1)) u(i)),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (SELECT d.doc_id, u.i, s.n, x.item FROM docs d, sizes s, unnest(range(1, len(d.w) - s.n + 2)) u(i)
         JOIN windows x ON x.n = s.n AND x.body = array_to_string(d.w[u.i : u.i + s.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def repeats(width: int = 13) -> str:
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
windows AS (SELECT doc_id, i, hash(array_to_string(w[i : i + {width - 1}], ' ')) AS a, md5(array_to_string(w[i : i + {width - 1}], ' ')) AS b FROM docs, unnest(range(1, len(w) - {width} + 2)) u(i)),
first AS (SELECT a, b, min(doc_id) AS f FROM windows GROUP BY 1, 2),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS p FROM windows JOIN first USING (a, b) WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def shingle_components(words: int = 4, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - {words - 1} + 1, least(len(w), 1) + 1))) u(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)"""


def _rule(host: str, path: str) -> tuple[str, str]:
    """CASE expressions for the name and the verdict of the longest fitting rule."""
    fits = [(f"({host} = '{x.host}' OR ends_with({host}, '.{x.host}')) AND starts_with({path}, '{x.path}')", x) for x in sorted(RULES, key=lambda x: -len(x.host + x.path))]
    return "CASE " + " ".join(f"WHEN {c} THEN '{x.host}{x.path}'" for c, x in fits) + " END", "CASE " + " ".join(f"WHEN {c} THEN '{x.verdict}'" for c, x in fits) + " END"


#: The SQL cuts a page at each < instead of searching for tags, and knows no base element, no references beyond &amp;
#: and no dots in paths.
_PIECES = "list_transform(string_split(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<'), lambda x: string_split(x, '>')[1])"
_QUOTES = "chr(34) || chr(39)"
_VALUE = r"(\x22[^\x22]*\x22|\x27[^\x27]*\x27|\S+)"
_REL = rf"regexp_matches(x, '^link\s', 'i') AND list_contains(string_split(lower(trim(regexp_extract(x, '\brel\s*=\s*{_VALUE}', 1, 'i'), {_QUOTES})), ' '), 'canonical')"
_HREF = rf"trim(regexp_extract(x, '\bhref\s*=\s*{_VALUE}', 1, 'i'), {_QUOTES})"
_AT_ONCE = r"regexp_matches(x, '^meta\s.*http-equiv\s*=\s*[\x22\x27]?refresh', 'is') AND regexp_matches(x, 'content\s*=\s*[\x22\x27]?\s*0+\s*[;,]', 'i')"
_TO = rf"trim(regexp_extract(x, 'url\s*=\s*(.*)$', 1, 'is'), {_QUOTES} || ' /')"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)://([^#]*)', 1)"
    return f"nullif(lower(regexp_extract({rest}, '^[^/?]*')) || rtrim(substr({rest}, length(regexp_extract({rest}, '^[^/?]*')) + 1), '/'), '')"


def url_filter() -> str:
    name, verdict = _rule("host", "path")
    _, aliased = _rule("regexp_extract(node, '^[^/?]*')", "(regexp_extract(node, '^[^/?]*([^?]*)', 1) || '/')")
    return f"""
WITH RECURSIVE pages_ AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
pieces AS (SELECT url, {_PIECES} AS p FROM pages_),
targets AS (SELECT url, replace(unnest([list_transform(list_filter(p, lambda x: {_REL}), lambda x: {_HREF})[1], list_transform(list_filter(p, lambda x: {_AT_ONCE}), lambda x: {_TO})[1]]), '&amp;', '&') AS t FROM pieces),
full_ AS (SELECT url, CASE WHEN regexp_matches(t, '^https?://', 'i') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
          WHEN starts_with(t, '/') THEN 'http://' || lower(regexp_extract(url, '(?s)://([^/?#]*)', 1)) || t
          ELSE 'http://' || lower(regexp_extract(url, '(?s)://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '(?s)://[^/?#]*([^?#]*/)', 1), ''), '/') || t END AS t
          FROM targets WHERE t <> '' AND (NOT regexp_matches(t, '^[a-z][a-z0-9+.-]*:', 'i') OR regexp_matches(t, '^https?://', 'i'))),
edges AS (SELECT DISTINCT a, b FROM (SELECT {_node('url')} AS a, {_node('t')} AS b FROM full_) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
judged AS (SELECT node, {aliased} AS v FROM (SELECT DISTINCT a AS node FROM both_ways)),
alias AS (SELECT r.node, CASE WHEN bool_or(coalesce(v = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(v = 'block', false)) THEN 'block' END AS v FROM reach r JOIN judged j ON j.node = r.other GROUP BY 1),
parts AS (SELECT page_id, url, lower(regexp_extract(url, '(?s)://([^/?#]*)', 1)) AS host, regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages_)
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, alias.v, 'allow') AS verdict FROM parts LEFT JOIN alias ON alias.node = {_node('url')}"""


def copies() -> str:
    return r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""


def divergence(least: int = 3, top: int = 200) -> str:
    terms = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
    share = lambda c, n: f"(1 + 1000000000::HUGEINT * ({c} + 1) // ({n} + v))"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {terms}) AS w FROM documents),
uses AS (SELECT i, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM uses GROUP BY 1, 2 HAVING count(DISTINCT i) >= {least}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM uses SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY 1, 2),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lang_c, {share("coalesce(c.c, 0)", "coalesce(t.n, 0)")} AS p, {share("k.c", "l.n")} AS q
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")})::BIGINT AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL SELECT lang, source, 'term', term, {f("p", "q")}::BIGINT FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""


ORACLE_SQL = {
    "op3_decontamination": decontamination(),
    "op5_relative_lz": repeats(),
    "op7_shingle_join": shingle_components(),
    "op10_url_filter": url_filter(),
    "op11_digest_index": copies(),
    "op12_source_divergence": divergence(),
}
