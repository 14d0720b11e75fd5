"""Oracle SQL of the survivorship queries."""

from catalith.llm.survivors import LICENCE_STAND_INS, TEXT_STAND_INS


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TEXT = r"trim(regexp_replace({c}, '[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+', ' ', 'g'))"
_MARK = r"'\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…)\s*$'"


def _squeezed(c: str) -> str:
    return _TEXT.format(c=c)


P1_FOUND_SQL = f"""
WITH keyed AS (
  SELECT v.*, coalesce(o.trust, 0) AS trust, lower(trim(package_id)) AS pid, regexp_replace(lower(trim(release_version)), '^v', '') AS ver
  FROM package_versions v LEFT JOIN origins o USING (origin) WHERE package_id IS NOT NULL AND release_version IS NOT NULL
), grouped AS (
  SELECT *, min(release_id) OVER w AS first_id, count(*) OVER w AS n FROM keyed WINDOW w AS (PARTITION BY pid, ver, channel)
), texts AS (
  SELECT first_id, 'summary' AS field_name, release_id, trust, fetched_at, summary AS t FROM grouped WHERE n > 1
  UNION ALL SELECT first_id, 'description', release_id, trust, fetched_at, description FROM grouped WHERE n > 1
), said AS (
  SELECT *, regexp_replace(lower({_squeezed("t")}), {_MARK}, '') AS bare FROM texts
  WHERE t IS NOT NULL AND lower({_squeezed("t")}) NOT IN ({_list(TEXT_STAND_INS)}) AND regexp_replace({_squeezed("t")}, {_MARK}, '') <> ''
), whole AS (
  SELECT * FROM said a WHERE NOT EXISTS (
    SELECT 1 FROM said b WHERE b.first_id = a.first_id AND b.field_name = a.field_name AND length(b.bare) > length(a.bare) AND starts_with(b.bare, a.bare))
), hosts AS (
  SELECT *, regexp_extract(regexp_replace(lower({_squeezed("homepage")}), '^(?:[a-z][a-z0-9+.-]*://|//|mailto:)', ''), '^(?:[^/@?#]*@)?([^/:?#]+)', 1) AS host
  FROM grouped WHERE n > 1 AND homepage IS NOT NULL
), candidates AS (
  SELECT first_id, field_name, release_id, trust, fetched_at FROM whole
  UNION ALL
  SELECT first_id, 'homepage', release_id, trust, fetched_at FROM hosts
  WHERE regexp_matches(host, '^[^.\\s]+(?:\\.[^.\\s]+)+$') AND NOT regexp_matches(host, '(^(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|about)$)|\\.(invalid|localhost)$')
    AND lower({_squeezed("homepage")}) NOT IN ({_list(TEXT_STAND_INS)})
  UNION ALL
  SELECT DISTINCT first_id, 'licenses', release_id, trust, fetched_at FROM (SELECT first_id, release_id, trust, fetched_at, unnest(licenses) AS entry FROM grouped WHERE n > 1)
  WHERE entry IS NOT NULL AND lower({_squeezed("entry")}) NOT IN ({_list(LICENCE_STAND_INS)})
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY first_id, field_name ORDER BY trust DESC, fetched_at DESC NULLS LAST, release_id DESC) AS r FROM candidates
)
SELECT first_id, field_name, release_id FROM ranked WHERE r = 1
"""

P1_RECORDS_SQL = f"""
WITH f AS ({P1_FOUND_SQL}), v AS (
  SELECT first_id, field_name, CASE field_name WHEN 'summary' THEN summary WHEN 'description' THEN description WHEN 'licenses' THEN array_to_string(list_filter(licenses, lambda x: x IS NOT NULL), '; ') ELSE homepage END AS value
  FROM f JOIN package_versions USING (release_id))
SELECT first_id, max(value) FILTER (field_name = 'summary') AS summary, max(value) FILTER (field_name = 'description') AS description,
  max(value) FILTER (field_name = 'licenses') AS licenses, max(value) FILTER (field_name = 'homepage') AS homepage FROM v GROUP BY first_id
"""
