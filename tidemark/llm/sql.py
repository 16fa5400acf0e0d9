"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Sites (sources) on which a line must stand; lines are trimmed of blanks.
OP2 = r"""
WITH docs AS (SELECT doc_id, text, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, site, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM docs WHERE text IS NOT NULL
),
named AS (SELECT *, trim(raw, E' \t\n\x0b\x0c\r') AS line FROM lines),
common AS (
  SELECT line, min(doc_id) AS first FROM named WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
),
marked AS (SELECT n.*, c.line IS NOT NULL AND n.doc_id <> c.first AS gone FROM named n LEFT JOIN common c USING (line)),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(c.text) AS n_chars_left, md5(c.text) AS text_md5
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
per AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM per
),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM caps WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
water AS (SELECT arg_min(level, cap / w) AS water FROM levels WHERE cap >= level * w),
targets AS (
  SELECT source, n, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce(water * w, cap)) END AS target FROM levels CROSS JOIN water
),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216.0::DOUBLE) ELSE 0 END::BIGINT AS each,
         length(bin(d.size)) AS band,
         ('0x' || substr(md5('11|' || coalesce(d.doc_id::VARCHAR, chr(0))), 1, 8))::BIGINT % ceil(t.n / 200000.0)::BIGINT AS part,
         ('0x' || substr(md5('11|' || coalesce(d.source, chr(0))), 1, 8))::BIGINT % 16777216 AS first
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
summed AS (
  SELECT *, first + coalesce(sum(each) OVER (PARTITION BY source ORDER BY band, part, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_from
  FROM placed
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * ((at_from + each) // 16777216 - at_from // 16777216))::BIGINT AS taken
FROM summed
"""

_SPELLED = """
SELECT {keep}, unnest(list_transform(range(1, length(p) - 2), lambda i: substring(p, i, 4))) AS gram
FROM (SELECT *, repeat(chr(2), 3) || translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(3) AS p FROM {urls})
"""

OP5 = f"""
WITH split AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM split),
parts AS (
  SELECT page_id, url, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substring(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path FROM hosts
),
named AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts
),
ruled AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM named),
urls AS (
  SELECT coalesce(r.url, '') AS url, any_value(by_rule) AS class,
         any_value(by_rule) IS NOT NULL AND ('0x' || substr(md5('calibrate|' || coalesce(r.url, '')), 1, 8))::BIGINT % 5 <> 0 AS learn
  FROM ruled r GROUP BY coalesce(r.url, '')
),
spelled AS ({_SPELLED.format(keep="url, (learn AND class = 'allow')::INT AS a, (learn AND class = 'block')::INT AS b", urls="urls")}),
grams AS (SELECT gram, sum(a) AS a, sum(b) AS b FROM spelled GROUP BY gram),
suffixes AS (SELECT gram, n, substring(gram, 5 - n) AS part, a, b FROM grams CROSS JOIN range(1, 5) r(n)),
counts AS (SELECT n, part, sum(a) AS a, sum(b) AS b FROM suffixes WHERE a + b > 0 GROUP BY n, part),
befores AS (
  SELECT n, substring(part, 1, n - 1) AS before, sum(a) AS ta, sum(b) AS tb, count(*) FILTER (WHERE a > 0) AS ua, count(*) FILTER (WHERE b > 0) AS ub
  FROM counts GROUP BY ALL
),
known AS (
  SELECT s.gram, s.n, coalesce(c.a, 0)::DOUBLE AS a, coalesce(c.b, 0)::DOUBLE AS b, coalesce(ta, 0)::DOUBLE AS ta, coalesce(tb, 0)::DOUBLE AS tb,
         coalesce(ua, 0)::DOUBLE AS ua, coalesce(ub, 0)::DOUBLE AS ub
  FROM suffixes s LEFT JOIN counts c ON c.n = s.n AND c.part = s.part LEFT JOIN befores f ON f.n = s.n AND f.before = substring(s.part, 1, s.n - 1)
),
p1 AS (SELECT gram, CASE WHEN ta > 0 THEN (a + ua / 256.0) / (ta + ua) ELSE 1 / 256.0 END AS pa, CASE WHEN tb > 0 THEN (b + ub / 256.0) / (tb + ub) ELSE 1 / 256.0 END AS pb FROM known WHERE n = 1),
p2 AS (SELECT gram, CASE WHEN ta > 0 THEN (a + ua * pa) / (ta + ua) ELSE pa END AS pa, CASE WHEN tb > 0 THEN (b + ub * pb) / (tb + ub) ELSE pb END AS pb FROM known JOIN p1 USING (gram) WHERE n = 2),
p3 AS (SELECT gram, CASE WHEN ta > 0 THEN (a + ua * pa) / (ta + ua) ELSE pa END AS pa, CASE WHEN tb > 0 THEN (b + ub * pb) / (tb + ub) ELSE pb END AS pb FROM known JOIN p2 USING (gram) WHERE n = 3),
p4 AS (SELECT gram, CASE WHEN ta > 0 THEN (a + ua * pa) / (ta + ua) ELSE pa END AS pa, CASE WHEN tb > 0 THEN (b + ub * pb) / (tb + ub) ELSE pb END AS pb FROM known JOIN p3 USING (gram) WHERE n = 4),
ratios AS (SELECT gram, round((ln(pa) - ln(pb)) * 1000000)::BIGINT AS ratio FROM p4),
scored AS (SELECT url, sum(ratio)::DOUBLE / count(*) / 1000000 AS score FROM spelled JOIN ratios USING (gram) GROUP BY url),
bins AS (
  SELECT floor(score * 1000)::BIGINT AS bin, (count(*) FILTER (WHERE class = 'allow'))::DOUBLE AS a, (count(*) FILTER (WHERE class = 'block'))::DOUBLE AS b
  FROM scored JOIN urls USING (url) WHERE class IS NOT NULL AND NOT learn GROUP BY ALL
),
cuts AS (
  SELECT bin, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(a) OVER ()
              + sum(b) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(b) OVER () AS errors,
         (coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin) / 2000.0::DOUBLE AS cut FROM bins
),
best AS (SELECT cut FROM cuts ORDER BY errors, bin LIMIT 1)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(by_rule, CASE WHEN s.score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(s.score, 6) AS score
FROM ruled r LEFT JOIN scored s ON s.url = coalesce(r.url, '') CROSS JOIN best
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
found AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
totals AS (SELECT lang, term, count(*) AS total FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
kinds AS (SELECT g.lang, count(t.term) AS v, coalesce(sum(t.total), 0) AS n FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN totals t USING (lang) GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN totals USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
priced AS (
  SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * k.v) AS p,
         1 + (1000000000::HUGEINT * (t.total + 5)) // (k.n + 5 * k.v) AS q
  FROM sizes s JOIN kinds k USING (lang) JOIN totals t USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
),
drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS a,
         ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op5_url_filter": OP5, "op10_mixing": OP10, "op11_source_divergence": OP11, "op13_fill_in_middle": OP13}
