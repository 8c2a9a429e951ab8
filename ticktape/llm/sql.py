"""DuckDB SQL for the queries that it can express, written from their definitions and not from the operators."""

from __future__ import annotations

from ticktape.llm import host_rules, spotsigs

_ANCHORS = ", ".join(f"'{w}'" for w in spotsigs.ANCHORS)


def _spots(text: str) -> str:
    """The sorted distinct spots of a text: an anchor and the first two other words of the next eight."""
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    chains = f"""list_transform(
        list_filter(range(1, len(words) + 1), lambda i: words[i] IN ({_ANCHORS})),
        lambda i: list_concat([words[i]], list_filter(words[i + 1:i + {spotsigs.REACH}], lambda w: w NOT IN ({_ANCHORS}))[1:{spotsigs.CHAIN}]))"""
    return f"""(SELECT CASE
        WHEN len(found) > 0 THEN found
        WHEN {text} = '' THEN CAST([] AS VARCHAR[])
        WHEN len(words) > 0 THEN ['= ' || array_to_string(words, ' ')]
        ELSE ['==' || {text}] END
      FROM (SELECT words, list_sort(list_distinct(list_transform(
        list_filter({chains}, lambda s: len(s) = {spotsigs.CHAIN + 1}), lambda s: array_to_string(s, ' ')))) AS found
        FROM (SELECT {words} AS words)))"""


def _likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text,
    coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS following
  FROM d),
edits AS (
  SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(following, 1, length(text) // 2) AS edited FROM pairs),
marked AS (
  SELECT *, {_spots("text")} AS own, {_spots("edited")} AS changed, {_spots("following")} AS beside FROM edits)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(own, chr(10))) AS fingerprint, sha256(array_to_string(changed, chr(10))) AS edited_fingerprint,
  {_likeness("own", "changed")} AS near_edited, {_likeness("own", "beside")} AS near_next, len(own) AS n_spots
FROM marked
"""

OP5 = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (
  SELECT *, list_transform(range(1, len(words) - {host_rules.WINDOW - 2}), lambda i: array_to_string(words[i:i + {host_rules.WINDOW - 1}], ' ')) AS runs FROM lines),
placed AS (SELECT doc_id, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS place FROM windows),
repeats AS (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place + step) AS n FROM repeats, range(0, {host_rules.WINDOW}) AS t(step) GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM windows LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {host_rules.LEAST_WORDS} OR 100 * n_repeat_words > {host_rules.MOST_REPEATED} * n_words AS base_failed,
    base_failed OR 10 * n_symbols > {host_rules.MOST_SYMBOLS} * n_words
    OR (n_dup_lines >= {host_rules.LEAST_DUP_LINES} AND 10 * n_dup_lines > {host_rules.MOST_DUP_LINES} * n_lines)
    OR word_chars < {host_rules.SHORTEST} * n_words OR word_chars > {host_rules.LONGEST} * n_words AS any_failed FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS failed FROM judged GROUP BY source),
average AS (SELECT count(*) AS hosts, sum(n) AS n, least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM hosts),
apart AS (SELECT sum(hosts.n * (hosts.failed / hosts.n - mean) ** 2) / any_value(average.n)
    - any_value(mean * (1 - mean) * hosts / average.n) AS beyond, any_value(mean) AS mean FROM hosts, average),
prior AS (SELECT mean, CASE WHEN beyond > 0 THEN least(greatest(mean * (1 - mean) / beyond - 1, {host_rules.WEAKEST}), {host_rules.STRONGEST})
    ELSE {host_rules.STRONGEST} END AS strength FROM apart),
verdicts AS (SELECT source, (failed + mean * strength) / (n + strength) > least(greatest(
    mean + {host_rules.FAR_OUT} * sqrt(mean * (1 - mean) / (strength + 1)), {host_rules.LEAST_LIMIT}), {host_rules.HOST_LIMIT}) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT any_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
judged AS (
  SELECT part, good.doc_id IS NOT NULL AS is_good, toxic.doc_id IS NOT NULL AS is_toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS fails
  FROM d LEFT JOIN good ON d.doc_id = good.doc_id LEFT JOIN toxic ON d.doc_id = toxic.doc_id),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS t(s)),
counted AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (fails & (earlier | bit) = 0) AS kept,
    count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0) AS removed,
    count(*) FILTER (fails & bit <> 0 AND fails & earlier <> 0) AS redundant,
    count(*) FILTER (fails = bit) AS unique_fails,
    count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0 AND is_good) AS good_lost,
    count(*) FILTER (fails & bit <> 0 AND fails & earlier = 0 AND is_toxic) AS toxic_lost
  FROM judged, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
found AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
words AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(words.n, 0) AS n, coalesce(langs.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN words USING (lang, source) LEFT JOIN langs USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.total + 2) // (langs.n + 2 * langs.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""
