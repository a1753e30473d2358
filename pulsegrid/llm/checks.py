"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

CHECKS: dict[str, str] = {}

CHECKS["op2_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         2 * source_size AS most, 1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM sums) AS whole
  FROM sums
), levels AS (  -- the level at which the sources of larger limit per weight share what the others leave
  SELECT a.source, (a.whole - coalesce(sum(b.most) FILTER (WHERE b.most * a.weight < a.most * b.weight), 0))
           / sum(b.weight) FILTER (WHERE b.most * a.weight >= a.most * b.weight) AS level
  FROM weighed a CROSS JOIN weighed b GROUP BY a.source, a.whole, a.weight, a.most
), split AS (
  SELECT w.*, w.most <= l.level * w.weight AS at_limit FROM weighed w JOIN levels l ON l.source IS NOT DISTINCT FROM w.source
), targets AS (
  SELECT source, source_size, CASE WHEN at_limit THEN CAST(most AS DOUBLE) ELSE
    (whole - (SELECT coalesce(CAST(sum(most) AS BIGINT), 0) FROM split WHERE at_limit)) * weight
      / (SELECT CAST(sum(weight) AS BIGINT) FROM split WHERE NOT at_limit) END AS target
  FROM split
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR) || ':', '') || 'mix-1'), 1, 13) AS BIGINT)
      / 4503599627370496.0::DOUBLE AS toss
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN toss < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

CHECKS["op8_window_dedup"] = rf"""
WITH split AS (
  SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM split
), windows AS (
  SELECT doc_id, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS win FROM starts
), least AS (
  SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p
  FROM windows JOIN least USING (win) WHERE first_doc < doc_id
), kept AS (
  SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split) s
  ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p
  GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split d LEFT JOIN kept k USING (doc_id)
"""

CHECKS["op10_decontaminate"] = rf"""
WITH docs AS (
  SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents
), items AS (
  SELECT item_id, {_WORDS.format("lower(text)")} AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), doc_shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), shared AS (
  SELECT doc_id, item_id, count(*) AS k FROM doc_shingles JOIN item_shingles USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(k AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_item, k::DOUBLE / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE k::DOUBLE / n >= 0.8
"""

CHECKS["op5_top_k"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
           list_transform(q.v, lambda x: CAST(x AS DOUBLE)), list_transform(c.v, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _moments(children: str) -> str:
    """The weight of a prior, from siblings (``n, k, pn, pk``) that count alike."""
    billionths = "CAST(sum(CAST(floor(1e9::DOUBLE * ({0})) AS BIGINT)) AS HUGEINT)"
    return f"""
  SELECT CASE WHEN c = 0 OR one <= apart THEN 10.0::DOUBLE WHEN same <= apart THEN 1000.0::DOUBLE ELSE
    least(greatest(1 / (CAST(same - apart AS DOUBLE) / CAST(one - apart AS DOUBLE)) - 1, 1.0::DOUBLE), 1000.0::DOUBLE) END
  FROM (SELECT count(*) AS c, {billionths.format("k * (k - 1::DOUBLE) / (n * (n - 1::DOUBLE))")} AS same,
          {billionths.format("k / n::DOUBLE * ((pk - k) / (pn - n)::DOUBLE)")} AS apart,
          {billionths.format("k / n::DOUBLE")} AS one
        FROM {children} WHERE n >= 2 AND pn > n)"""


CHECKS["op11_url_filter"] = rf"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_ABC}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rests
), rules(rule, name, start, says) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
         ('net/fr/', 'net', '/fr/', 'block')
), ruled AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM (SELECT DISTINCT page_id, host, path FROM cut)
  JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY page_id
), marks AS (
  SELECT doc_id, min(coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0) AS good
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, count(good) AS n, count(*) FILTER (WHERE good) AS k FROM cut LEFT JOIN marks ON doc_id = page_id GROUP BY host
), bares AS (
  SELECT *, regexp_replace(regexp_replace(list_last(string_split(host, '@')), ':[0-9]*$', ''), '[.]+$', '') AS bare FROM counts
), labelled AS (
  SELECT *, string_split(bare, '.') AS l, regexp_full_match(bare, '[0-9]+([.][0-9]+){{3}}') OR starts_with(bare, '[') AS ip FROM bares
), depths AS (
  SELECT *, CASE WHEN length(l[-1]) = 2 AND coalesce(l[-2], l[-1]) IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'gouv', 'mil', 'ne', 'net', 'nom',
    'or', 'org', 'sch') THEN 2 ELSE 1 END AS depth FROM labelled
), named AS (
  SELECT host, n, k, CASE WHEN ip THEN bare ELSE array_to_string(l[-1 - depth:], '.') END AS domain,
         CASE WHEN ip THEN 'ip' ELSE array_to_string(l[-depth:], '.') END AS suffix
  FROM depths
), tops AS (
  SELECT suffix, n, k, CAST(sum(n) OVER () AS BIGINT) AS pn, CAST(sum(k) OVER () AS BIGINT) AS pk
  FROM (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM named GROUP BY suffix)
), top AS (
  SELECT suffix, n AS pn, k AS pk, (pk - k + 2::DOUBLE * 0.5::DOUBLE) / (pn - n + 2::DOUBLE) AS pprior, ({_moments("tops")}) AS pweight
  FROM tops
), doms AS (
  SELECT d.*, pn, pk, pprior, pweight
  FROM (SELECT suffix, domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM named GROUP BY ALL) d JOIN top USING (suffix)
), dom AS (
  SELECT suffix, domain, n AS pn, k AS pk, (pk - k + pweight * pprior) / (pn - n + pweight) AS pprior, ({_moments("doms")}) AS pweight
  FROM doms
), sites AS (
  SELECT named.*, pn, pk, pprior, pweight FROM named JOIN dom USING (suffix, domain)
), weighed AS (
  SELECT host, n, k, (pk - k + pweight * pprior) / (pn - n + pweight) AS prior, ({_moments("sites")}) AS weight FROM sites
), rated AS (
  SELECT host, weight + n AS total, (weight * prior + k) / (weight + n) AS rate FROM weighed
)
SELECT c.page_id, c.host, c.path, r.rule, coalesce(r.says, CASE WHEN t.rate + 1.645::DOUBLE * sqrt(t.rate * (1 - t.rate) / (t.total + 1))
         < 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c LEFT JOIN ruled r USING (page_id) JOIN rated t USING (host)
"""

CHECKS["op13_filter_audit"] = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents
), masked AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER same, min(doc_id) OVER same IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM texts WINDOW same AS (PARTITION BY t)
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id
), rows_ AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM masked LEFT JOIN marks USING (doc_id)
), letters(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
  FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM rows_ GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
