"""SQL counterparts, written for DuckDB over the given tables.

They state the rules once more in another form (windows and recursion where
the Spark side uses array expressions), so that a match means something.
"""

from __future__ import annotations

from ..functions.text import BULLETS, DASHES, DROPPED, ITEM_PREFIX, ITEM_SUFFIX, ODD_SPACES, SPACE, TOKEN, TOKEN_AND_BLANK
from ..operators.entities import TECH_WHITELIST
from .views import STOP_WORDS

# How the given pages are written: what the page reader must find is stated on its own here.
UNSEEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
BOILERPLATE = r'(?is)<nav[^>]*>.*?</nav>|<div class="ad">.*?</div>|<footer[^>]*>.*?</footer>'
LINE_TAGS = r"(?i)</?(p|br|h[1-6]|li|ul|ol|div|tr)(\s[^>]*)?/?>"
ANY_TAG = r"<[^>]*>"
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"replace(coalesce({x}, ''), chr(65279), '')")


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{SPACE}]+')) AS INT)"


def tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN}')) AS INT)"


def sents(x: str) -> str:
    s = strip(x)
    return f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_extract_all({s}, '[.!?…]+[{SPACE}]+')) + 1 END AS INT)"


def normalize(x: str) -> str:
    x = f"translate({x}, '{DASHES + BULLETS + ODD_SPACES}', '{'-' * len(DASHES + BULLETS)}{' ' * len(ODD_SPACES)}')"
    for gone in DROPPED:
        x = f"replace({x}, '{gone}', '')"
    x = f"regexp_replace({x}, '-{{2,}}', '-', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(x)


def qualification(x: str) -> str:
    x = strip(f"coalesce({x}, '')")
    x = f"regexp_replace({x}, '^[{SPACE}{ITEM_PREFIX}]+', '')"
    x = strip(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")
    return f"rtrim({x}, {lit(ITEM_SUFFIX)})"


def label(job: str = "prob_job", blurb: str = "prob_blurb_legal", offer: str = "prob_offer_detail") -> str:
    top = f"greatest({job}, {blurb}, {offer})"
    return (
        f"CASE WHEN {blurb} > 0.4 AND NOT {job} > 0.4 THEN 'blurb_legal' "
        f"WHEN {job} > 0.4 OR {top} - {job} < 0.15 OR {top} < 0.3 THEN 'job' "
        f"WHEN {job} = {top} THEN 'job' WHEN {blurb} = {top} THEN 'blurb_legal' ELSE 'offer_detail' END"
    )


def scores(source: str) -> str:
    def part(a: int, b: int, m: int) -> str:
        return f"CAST((des_id * {a} + par_id * {b}) % {m} + 1 AS DOUBLE)"

    return (
        "SELECT des_id, par_id, text, a / (a + b + c) AS prob_job, b / (a + b + c) AS prob_blurb_legal, "
        f"c / (a + b + c) AS prob_offer_detail FROM (SELECT des_id, par_id, text, {part(7, 3, 97)} AS a, "
        f"{part(5, 11, 89)} AS b, {part(3, 13, 83)} AS c FROM {source})"
    )


VIEWS: dict[str, str] = {}

VIEWS["posts"] = """
SELECT doc_id AS row_key, concat('run_', lang, '.csv') AS source_file,
  CASE WHEN doc_id % 7 = 0 THEN concat(source, ' | ', lang) ELSE source END AS SearchTerm,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS Title,
  text AS Description, string_split(text, chr(10))[2:] AS quals,
  array_to_string(string_split(text, chr(10))[2:], ' | ') AS Qualifications,
  CASE WHEN doc_id % 50 = 0 THEN '' ELSE concat('https://jobs.example.org/job/', md5(split_part(text, chr(10), 1))) END AS Link
FROM documents"""
VIEWS["clean_posts"] = f"""
SELECT row_key, source_file, {clean('SearchTerm')} AS SearchTerm, {clean('Title')} AS Title,
  {clean('Description')} AS Description, {clean('Qualifications')} AS Qualifications, {clean('Link')} AS Link
FROM posts WHERE {clean('Link')} <> ''"""
VIEWS["paras"] = """
SELECT doc_id AS des_id, CAST(i - 1 AS INT) AS par_id, x AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents)"""
VIEWS["scored"] = scores("paras")
VIEWS["predicted"] = f"SELECT *, {label()} AS prediction FROM scored"
VIEWS["labels3"] = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'CONDITIONS' WHEN quality = 1 THEN 'JOB' ELSE 'CONTEXT' END AS label FROM labels"""
VIEWS["predictions"] = f"""
SELECT des_id, par_id, text, p_JOB, p_CONTEXT, p_CONDITIONS, "true", m.model_name AS model_name, m.pred AS pred FROM (
  SELECT s.des_id, s.par_id, s.text, s.prob_job AS p_JOB, s.prob_blurb_legal AS p_CONTEXT, s.prob_offer_detail AS p_CONDITIONS,
    l.label AS "true", unnest([
      {{'model_name': 'rule', 'pred': CASE {label()} WHEN 'job' THEN 'JOB' WHEN 'blurb_legal' THEN 'CONTEXT' ELSE 'CONDITIONS' END}},
      {{'model_name': 'keen', 'pred': CASE WHEN prob_job > 0.3 THEN 'JOB' ELSE 'CONTEXT' END}},
      {{'model_name': 'shy', 'pred': CASE WHEN prob_job > 0.6 THEN 'JOB' ELSE 'CONDITIONS' END}}]) AS m
  FROM scored s JOIN labels3 l ON l.doc_id = s.des_id)"""
VIEWS["vectors"] = """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS des_id, CAST(vec_id % 5 AS INT) AS par_id, embedding, label FROM embeddings"""
VIEWS["blobs"] = """
SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x, i:
    CAST(x AS DOUBLE) * (CASE WHEN vec_id % 25 = 0 THEN 1.0::DOUBLE ELSE 0.07::DOUBLE END)
    + (CASE WHEN vec_id % 25 <> 0 AND i - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v
  FROM embeddings)"""
VIEWS["topics"] = """
SELECT d.doc_id, e.label AS topic, d.text FROM documents d JOIN embeddings e
ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)"""
VIEWS["gazetteer"] = """
SELECT DISTINCT lower(t) AS token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM benchmark)
WHERE length(t) >= 9"""
VIEWS["crawl"] = """
SELECT search_term, pages_attempted, pages_visited, jobs_collected, links_discovered - jobs_collected AS job_parse_failures,
  links_discovered FROM (
  SELECT concat('term ', user_id % 6) AS search_term,
    count(*) FILTER (event_type IN ('view', 'error')) AS pages_attempted,
    count(*) FILTER (event_type = 'view') AS pages_visited,
    count(*) FILTER (event_type IN ('click', 'purchase')) AS links_discovered,
    count(*) FILTER (event_type = 'purchase') AS jobs_collected
  FROM events GROUP BY ALL)"""
VIEWS["terms"] = f"""
SELECT DISTINCT concat('term ', user_id % 8) AS search_term FROM events"""

# --- segmentation ---------------------------------------------------------------


def segmentation(source: str, para_sep: str) -> dict[str, str]:
    """Views from ``source(des_id, Description)`` down to paragraphs."""
    sep = {"\n": "chr(10)", "\n\n": "chr(10) || chr(10)"}[para_sep]
    bare = strip("text")
    return {
        "lines": f"""
SELECT des_id, CAST(i - 1 AS INT) AS line, text, ({bare} <> '' AND ({words('text')} <= 3 OR {bare} LIKE '%:')) AS is_header
FROM (SELECT des_id, unnest(string_split(Description, chr(10))) AS text,
        generate_subscripts(string_split(Description, chr(10)), 1) AS i FROM {source})""",
        "segs": f"""
SELECT des_id, seg, string_agg(text, chr(10) ORDER BY line) AS text FROM (
  SELECT *, CAST(sum(CASE WHEN is_header OR line = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY des_id ORDER BY line) - 1 AS INT) AS seg
  FROM lines) GROUP BY des_id, seg""",
        "segments": f"SELECT des_id, seg, text, {sents('text')} AS n_sents FROM segs",
        "islands": f"""
SELECT des_id, island, {strip("string_agg(text, chr(10) ORDER BY seg)")} AS text, max(n_sents) <= 1 AS tail FROM (
  SELECT *, CAST(coalesce(sum(CASE WHEN n_sents > 1 THEN 1 ELSE 0 END) OVER
    (PARTITION BY des_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS island
  FROM segments) GROUP BY des_id, island HAVING {strip("string_agg(text, chr(10) ORDER BY seg)")} <> ''""",
        "long_islands": f"SELECT * FROM islands WHERE NOT tail AND {tokens('text')} >= 120",
        "raw_parts": f"""
SELECT des_id, island, i, {strip('x')} AS x FROM (SELECT des_id, island, unnest(string_split(text, {sep})) AS x,
  generate_subscripts(string_split(text, {sep}), 1) AS i FROM long_islands)""",
        "parts": f"""
SELECT des_id, island, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY des_id, island) AS n, {sents('x')} AS s
FROM raw_parts WHERE x <> '' WINDOW w AS (PARTITION BY des_id, island ORDER BY i)""",
        "pieces": """
SELECT des_id, island, grp, string_agg(x, chr(10) ORDER BY i) AS text FROM (
  SELECT *, coalesce(sum(CASE WHEN s > 2 OR i = n THEN 1 ELSE 0 END) OVER
    (PARTITION BY des_id, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM parts)
GROUP BY des_id, island, grp""",
        "to_pack": f"SELECT concat(des_id, '/', island, '/', grp) AS k, des_id, island, grp, text FROM pieces WHERE {words('text')} > 320",
        **packing("to_pack", 120, 3),
        "sub_pars": f"""
SELECT des_id, island, CAST(0 AS BIGINT) AS grp, 0 AS chunk, text FROM islands WHERE tail OR {tokens('text')} < 120
UNION ALL SELECT des_id, island, CAST(grp AS BIGINT), 0, text FROM pieces WHERE {words('text')} <= 320
UNION ALL SELECT p.des_id, p.island, CAST(p.grp AS BIGINT), c.chunk, c.text FROM packed c JOIN to_pack p USING (k)""",
        "paragraphs": """
SELECT des_id, CAST(row_number() OVER (PARTITION BY des_id ORDER BY island, grp, chunk) - 1 AS INT) AS par_id, text
FROM sub_pars""",
    }


def packing(source: str, max_tokens: int, per_chunk: int) -> dict[str, str]:
    """``packed(k, chunk, text)`` from ``source(k, text)`` by recursion over sentences."""
    return {
        "cut": f"""
SELECT k, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]+)[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: {strip('s')}), lambda s: s <> '') AS l FROM {source}""",
        "numbered": f"SELECT k, s, {words('s')} AS w, i FROM (SELECT k, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM cut)",
        "walk": f"""
SELECT k, i, s, 0 AS chunk, w AS held, 1 AS n FROM numbered WHERE i = 1
UNION ALL
SELECT b.k, b.i, b.s, a.chunk + CASE WHEN a.held + b.w > {max_tokens} OR a.n >= {per_chunk} THEN 1 ELSE 0 END,
  CASE WHEN a.held + b.w > {max_tokens} OR a.n >= {per_chunk} THEN b.w ELSE a.held + b.w END,
  CASE WHEN a.held + b.w > {max_tokens} OR a.n >= {per_chunk} THEN 1 ELSE a.n + 1 END
FROM walk a JOIN numbered b ON b.k = a.k AND b.i = a.i + 1""",
        "packed": "SELECT k, chunk, string_agg(s, ' ' ORDER BY i) AS text FROM walk GROUP BY k, chunk",
    }


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (in order) and the extra ones, then ``body``."""
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    # A view whose name ends in an underscore is computed once.
    ctes += [f"{n} AS {'MATERIALIZED ' * n.endswith('_')}({q.strip()})" for n, q in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


DOCS = "(SELECT doc_id AS des_id, text AS Description FROM documents)"

# --- topics -----------------------------------------------------------------------

_STOPS = ", ".join(lit(w) for w in STOP_WORDS)
TOPIC_VIEWS = {
    "toks": f"""
SELECT doc_id, topic, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9\\s]+', '', 'g'), '[a-z0-9]{{2,}}'),
  lambda t: t NOT IN ({_STOPS})) AS t FROM topics""",
    "grams": """
SELECT doc_id, topic, t[i] AS term FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM toks)
UNION ALL SELECT doc_id, topic, t[i] || ' ' || t[i + 1] FROM (SELECT *, unnest(range(1, len(t))) AS i FROM toks)
UNION ALL SELECT doc_id, topic, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM (SELECT *, unnest(range(1, len(t) - 1)) AS i FROM toks)""",
    "counted": "SELECT topic, term, count(*) AS tf FROM grams GROUP BY topic, term",
    "kept": """
SELECT topic, term, tf FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM counted)
WHERE df >= 0.1 * (SELECT count(DISTINCT topic) FROM topics) AND df <= 0.8 * (SELECT count(DISTINCT topic) FROM topics)""",
    "sizes": "SELECT topic, sum(tf) AS size FROM kept GROUP BY topic",
    "weights": """
SELECT topic, term, tf, tf / size * ln(1 + (SELECT floor(avg(size)) FROM sizes) / f) AS weight
FROM kept JOIN (SELECT term, sum(tf) AS f FROM kept GROUP BY term) USING (term) JOIN sizes USING (topic)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS r FROM weights",
    "info": """
SELECT topic, n AS "count", concat(topic, '_', w4) AS name, words FROM
  (SELECT topic, count(*) AS n FROM topics GROUP BY topic) JOIN
  (SELECT topic, string_agg(term, '_' ORDER BY r) FILTER (r <= 4) AS w4, string_agg(term, ',' ORDER BY r) AS words
   FROM ranked WHERE r <= 10 GROUP BY topic) USING (topic)""",
}


# --- clusters ---------------------------------------------------------------------


def density_hierarchy(points: str, size: int, samples: int, epsilon: float) -> dict[str, str]:
    """Views from ``points(id, v)`` to ``labelled(id, component, strength)``: clusters by excess of mass.

    A tree grown point by point, its links merged one by one with the labels of all
    points in a list, and clusters read off the labels at every distance.
    """
    far = "1e300::DOUBLE"
    return {
        "ids": f"SELECT id, v, row_number() OVER (ORDER BY id) AS i FROM {points}",
        "gaps": "SELECT a.i AS a, b.i AS b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM ids a JOIN ids b ON a.i <> b.i",
        "cores": f"SELECT a AS i, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS n FROM gaps) WHERE n = {samples}",
        "reach": f"""
SELECT x.i, list(CASE WHEN x.i = y.i THEN {far} ELSE greatest(d, x.core, y.core) END ORDER BY y.i) AS w
FROM cores x JOIN cores y ON true LEFT JOIN gaps ON a = x.i AND b = y.i GROUP BY x.i""",
        "prim": f"""
SELECT 0 AS step, CAST(1 AS BIGINT) AS b, CAST(1 AS BIGINT) AS a, 0.0::DOUBLE AS w, r.w AS near, list_transform(r.w, lambda x: CAST(1 AS BIGINT)) AS via, list_transform(r.w, lambda x, k: k = 1) AS used
FROM reach r WHERE i = 1
UNION ALL
SELECT step + 1, j, via[j], low, list_transform(near, lambda x, k: least(x, r.w[k])), list_transform(via, lambda x, k: CASE WHEN r.w[k] < near[k] THEN j ELSE x END), list_transform(used, lambda x, k: x OR k = j)
FROM (SELECT *, CAST(list_position(masked, low) AS BIGINT) AS j FROM (SELECT *, list_min(masked) AS low FROM (
  SELECT *, list_transform(near, lambda x, k: CASE WHEN used[k] THEN {far} ELSE x END) AS masked FROM prim WHERE step < len(near) - 1))) JOIN reach r ON r.i = j""",
        "links_": "SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM prim WHERE step > 0",
        "merged": """
SELECT CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS w, list(i ORDER BY i) AS l FROM ids
UNION ALL
SELECT k, w, list_transform(l, lambda x: CASE WHEN x = gone THEN stays ELSE x END)
FROM (SELECT e.k, e.w, l, greatest(l[e.a], l[e.b]) AS gone, least(l[e.a], l[e.b]) AS stays FROM merged JOIN links_ e ON e.k = merged.k + 1)""",
        "levels": "SELECT row_number() OVER (ORDER BY w) AS r, w, l FROM (SELECT w, arg_max(l, k) AS l FROM merged WHERE k > 0 GROUP BY w)",
        "held": "SELECT r, w, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM levels",
        "bigs": f"SELECT r, c, any_value(w) AS w FROM held GROUP BY r, c HAVING count(*) >= {size}",
        "inner_": "SELECT DISTINCT y.r, y.c, x.c AS child FROM bigs x JOIN held h ON h.r = x.r AND h.i = x.c JOIN held y ON y.r = x.r + 1 AND y.i = h.i",
        "kids": "SELECT b.r, b.c, b.w, count(child) AS n, any_value(child) AS child FROM bigs b LEFT JOIN inner_ USING (r, c) GROUP BY ALL",
        "chain": """
SELECT r, c, r AS start, c AS head, w AS low FROM kids WHERE n <> 1
UNION ALL
SELECT k.r, k.c, start, head, low FROM chain JOIN kids k ON k.r = chain.r + 1 AND k.n = 1 AND k.child = chain.c""",
        "ends": "SELECT start, head, low, max(r) AS r, arg_max(c, r) AS c FROM chain GROUP BY start, head, low",
        "numbered_": "SELECT *, row_number() OVER (ORDER BY start, head) AS g FROM ends",
        "clusters": """
SELECT e.g, e.low, e.r, e.c, p.g AS parent, u.w AS high FROM numbered_ e LEFT JOIN inner_ k ON k.r = e.r + 1 AND k.child = e.c
LEFT JOIN numbered_ p ON p.start = k.r AND p.head = k.c LEFT JOIN bigs u ON u.r = k.r AND u.c = k.c""",
        "joined": "SELECT i, min(w) AS d FROM held JOIN bigs USING (r, c, w) GROUP BY i",
        "weighed": """
SELECT g, any_value(parent) AS parent, any_value(high) AS high, any_value(low) AS low,
  sum(1 / greatest(j.d, low, 1e-9) - CASE WHEN high IS NULL THEN 0 ELSE 1 / greatest(high, 1e-9) END) AS mass
FROM clusters s JOIN held h ON h.r = s.r AND h.c = s.c JOIN joined j ON j.i = h.i GROUP BY g""",
        "mass_of": "SELECT list(mass ORDER BY g) AS m, list(coalesce(parent, 0) ORDER BY g) AS p FROM weighed",
        "eom": """
SELECT 0 AS g, list_transform(m, lambda x: 0.0::DOUBLE) AS under, list_transform(m, lambda x: false) AS keep FROM mass_of
UNION ALL
SELECT e.g + 1, list_transform(under, lambda x, k: CASE WHEN k = p[e.g + 1] THEN x + greatest(under[e.g + 1], CASE WHEN p[e.g + 1] = 0 THEN 0 ELSE m[e.g + 1] END) ELSE x END),
  list_transform(keep, lambda x, k: CASE WHEN k = e.g + 1 THEN p[k] > 0 AND under[k] <= m[k] ELSE x END)
FROM eom e, mass_of WHERE e.g < len(m)""",
        "above": "SELECT g, parent AS a FROM weighed WHERE parent IS NOT NULL UNION ALL SELECT above.g, w.parent FROM above JOIN weighed w ON w.g = above.a WHERE w.parent IS NOT NULL",
        "kept_": "SELECT unnest(keep) AS keep, generate_subscripts(keep, 1) AS g FROM (SELECT arg_max(keep, g) AS keep FROM eom)",
        "tops": "SELECT k.g FROM kept_ k WHERE keep AND NOT EXISTS (SELECT 1 FROM above x JOIN kept_ y ON y.g = x.a WHERE x.g = k.g AND y.keep)",
        "climb": f"""
SELECT t.g AS here, high < {epsilon} AS go, 0 AS step FROM tops t JOIN weighed USING (g)
UNION ALL
SELECT CASE WHEN p.parent IS NULL THEN c.here ELSE p.g END, p.parent IS NOT NULL AND p.high <= {epsilon}, step + 1
FROM climb c JOIN weighed w ON w.g = c.here JOIN weighed p ON p.g = w.parent WHERE go""",
        "lifted": "SELECT DISTINCT here AS g FROM climb WHERE NOT go",
        "picks": "SELECT g FROM lifted l WHERE NOT EXISTS (SELECT 1 FROM above x JOIN lifted y ON y.g = x.a WHERE x.g = l.g)",
        "found": "SELECT h.i, s.g, s.low FROM picks JOIN clusters s USING (g) JOIN held h ON h.r = s.r AND h.c = s.c",
        "labelled": """
SELECT x.id, min(x.id) OVER (PARTITION BY g) AS c, g, least(1, greatest(low, 1e-9) / greatest(d, 1e-9)) AS s
FROM ids x LEFT JOIN found USING (i) LEFT JOIN joined USING (i)""",
    }
