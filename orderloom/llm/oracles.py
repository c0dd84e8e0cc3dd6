"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import fill_in_middle, pii, secret_scan


def _pii() -> str:
    """Each kind: split and extract alternate; prefix sums of lengths give positions."""
    ip = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::int "
            "WHEN c::int > 4 THEN 2 * c::int - 9 ELSE 2 * c::int END)) % 10 = 0")
    solid = "replace(m, ' ', '')"
    mod97 = (f"list_reduce(list_transform(string_split({solid}[5:] || {solid}[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), "
             "lambda a, x: CASE WHEN x >= 10 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END, 0) = 1")
    rule = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(m, '{ip}(\.{ip}){{3}}')"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        "iban": (pii.IBAN.pattern, f"length({solid}) BETWEEN 15 AND 34 AND {mod97}"),
        "secret": (pii.SECRET.pattern, "m[1:4] = 'AKIA' OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))"),
    }
    parts = []
    for i, k in enumerate(pii.KINDS):
        pattern, keep = rule[k.name]
        near = "right(p, 40)" if k.name != "secret" else "right(p, 40) || m"
        need = f" AND score >= {k.least}" if k.least > k.base else ""
        parts.append(f"""
SELECT doc_id, {i} AS ord, '{k.name}' AS kind, s AS start, s + length(m) AS "end", score FROM (
 SELECT doc_id, m, list_sum(list_transform(ps[:j], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[:j - 1], lambda x: length(x))), 0)::bigint AS s,
        least(1.0, {k.base} + CASE WHEN regexp_matches({near}, '(?i){k.words}') THEN {k.lift} ELSE 0 END) AS score, ({keep}) AS keep
 FROM (SELECT doc_id, ps, ms, unnest(range(1, length(ms) + 1)) AS j, unnest(ms) AS m, unnest(ps[:length(ms)]) AS p
       FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM d))) WHERE keep{need}""")
    spans = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(ord) FILTER (ord = {i}) AS n_{k.name}" for i, k in enumerate(pii.KINDS))
    listing = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, ord, \"end\"){}, '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({spans})
SELECT d.doc_id, {counts}, sha256({listing.format(" FILTER (ord < 4)")}) AS base_sha256, {listing.format("")} AS spans,
 coalesce(string_agg(format('{{:.2f}}', score::double), ',' ORDER BY start, ord, "end"), '') AS scores
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


LINE_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, length(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
base AS (SELECT w.doc_id, length(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (length(l) - length(list_distinct(l)))::bigint AS n_dup_lines,
   coalesce(c.n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
x AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d),
y AS (SELECT doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
   length(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS n FROM x),
ln AS (SELECT host, line, doc_id, sum(n) AS n FROM y WHERE n > 0 GROUP BY host, line, doc_id),
hd AS (SELECT host, count(*) AS hd FROM d GROUP BY host),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS nd FROM ln GROUP BY host, line) JOIN hd USING (host) WHERE nd > 30 OR (nd > 10 AND nd > 0.2 * hd)),
cut AS (SELECT doc_id, sum(n)::bigint AS removed_words, count(*)::bigint AS removed_lines FROM ln JOIN b USING (host, line) GROUP BY doc_id),
o AS (SELECT base.*, coalesce(removed_words, 0)::bigint AS removed_words, coalesce(removed_lines, 0)::bigint AS removed_lines,
   (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base LEFT JOIN cut ON base.doc_id = cut.doc_id)
SELECT *, n_words - removed_words AS left_words, (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words) AS depleted,
   NOT base_failed AND NOT (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words) AS kept FROM o"""


NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN length(w) = 0 THEN [] WHEN length(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, length(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, g, n FROM s JOIN n ON s.doc_id = n.doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM k x JOIN k y ON x.g = y.g
   AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id) WHERE 100 * c >= 90 * (na + nb - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0)::bigint AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes, sha1(h) AS x FROM p),
o AS (SELECT x, min(page_id) AS o FROM d GROUP BY x)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   ((('0x' || substr(d.x, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to, true AS intact
FROM d JOIN o ON d.x = o.x"""


RANKED_SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, len(w)::bigint AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*)::bigint AS nd, sum(n)::bigint AS nt FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, count(*)::bigint AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
v AS (SELECT t, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * nd) // nt) AS m FROM n, s),
x AS (SELECT item_id, doc_id, sum(v.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score FROM q JOIN p ON q.t = p.t JOIN v ON q.t = v.t JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def _secrets() -> str:
    """Samples, weights, then each kind's spans as in ``_pii``."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    assign, access, hex_, run = map(q, secret_scan.PATTERNS)
    keep = [f"length(regexp_extract(m, {assign}, 2)) >= {secret_scan.LEAST_VALUE}", "true", "true", f"score >= {secret_scan.LEAST_SCORE}"]
    score = ["0", "0", "0", "(SELECT sum(w) FROM (SELECT unnest(range(1, length(m))) AS i) JOIN wt ON wt.p = m[i:i + 1])"]
    parts = [f"""
SELECT doc_id, {i} AS ord, '{n}' AS kind, s AS start, s + length(m) AS "end", score FROM (
 SELECT doc_id, m, list_sum(list_transform(ps[:j], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[:j - 1], lambda x: length(x))), 0)::bigint AS s, {score[i]} AS score
 FROM (SELECT doc_id, ps, ms, unnest(range(1, length(ms) + 1)) AS j, unnest(ms) AS m
       FROM (SELECT doc_id, string_split_regex(t, {p}) AS ps, regexp_extract_all(t, {p}) AS ms FROM d))) WHERE {keep[i]}""" for i, (n, p) in enumerate(zip(secret_scan.NAMES, (assign, access, hex_, run)))]
    counts = ", ".join(f"count(ord) FILTER (ord = {i}) AS n_{n}" for i, n in enumerate(secret_scan.NAMES))
    listing = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, ord, \"end\"){}, '')"
    k, some = secret_scan.K, secret_scan.CLASS
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ids AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) ORDER BY md5(doc_id::varchar), doc_id LIMIT {secret_scan.SAMPLE_ROWS}),
st AS (SELECT t FROM d JOIN ids ON d.doc_id = ids.doc_id),
smp AS (SELECT DISTINCT value, label FROM (
  SELECT unnest([to_base64(unhex(sha256(doc_id::varchar))), upper(sha256(doc_id::varchar || 'u')), sha256(doc_id::varchar || 'l')]) AS value, 1 AS label FROM ids
  UNION ALL SELECT value, 1 FROM (SELECT unnest(regexp_extract_all(t, {assign}, 2) || regexp_extract_all(t, {access}) || regexp_extract_all(t, {hex_})) AS value FROM st) WHERE length(value) >= {secret_scan.LEAST_VALUE}
  UNION ALL SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, {assign}, ' ', 'g'), {access}, ' ', 'g'), {hex_}, ' ', 'g'), '{some}{{{secret_scan.LEARN_CHARS},}}')), 0 FROM st)),
pr AS (SELECT label, value[i:i + 1] AS p FROM (SELECT label, value, unnest(range(1, length(value))) AS i FROM smp)),
al AS (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS c),
cn AS (SELECT p, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM pr GROUP BY p),
ct AS (SELECT a.c AS a, a.c || b.c AS p, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM al a CROSS JOIN al b LEFT JOIN cn ON cn.p = a.c || b.c),
wt AS (SELECT p, floor(1000 * ln(((n1 + 1) * (sum(n0) OVER x + {k}))::double / ((n0 + 1) * (sum(n1) OVER x + {k}))::double) + 0.5)::bigint AS w FROM ct WINDOW x AS (PARTITION BY a)),
s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256({listing.format(f" FILTER (ord < {secret_scan.BASE})")}) AS base_sha256, {listing.format("")} AS spans,
 coalesce(string_agg(score::varchar, ',' ORDER BY start) FILTER (ord = {secret_scan.BASE}), '') AS scores
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


def _fill_in_middle(rule: fill_in_middle.Rule) -> str:
    p, s, m = fill_in_middle.MARKS
    part = lambda lo, hi: f"array_to_string(u[{lo}:{hi}], '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{rule.seed}:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(u)::bigint AS n, h1 % (len(u) + 1) AS x, h2 % (len(u) + 1) AS y,
   CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {rule.percent} THEN 'plain' WHEN h4 % 100 < {rule.spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
b AS (SELECT doc_id, t, n, form, {part(1, "least(x, y)")} AS prefix, {part("least(x, y) + 1", "greatest(x, y)")} AS middle, {part("greatest(x, y) + 1", "n")} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::bigint END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM b"""


def all_sql() -> dict[str, str]:
    return {"op2_pii": _pii(), "op4_line_rules": LINE_RULES, "op7_ngram_join": NGRAM_JOIN, "op8_warc": WARC,
            "op11_ranked_search": RANKED_SEARCH, "op12_secrets": _secrets(), "op13_fill_in_middle": _fill_in_middle(fill_in_middle.Rule())}
