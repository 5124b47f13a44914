"""DuckDB SQL for the text operators that SQL can express, over whole tables."""

from __future__ import annotations

from martlens.llm.licences import COPYRIGHT_LINE, LICENCE_TEXTS, SPELLINGS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separator: str) -> str:
    return f"[x for x in string_split_regex({text}, '{separator}') if x <> '']"


_SPACE = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LINE = _LOWER.format("line")

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, text FROM documents
), w AS (SELECT r, {_words('t', _SPACE)} AS w FROM d),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), raw_lines AS (
  SELECT r, doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM d
), lines AS (
  SELECT *, trim(regexp_replace(regexp_replace({_LINE}, '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g')) AS norm
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT (doc_id, text)) AS n FROM documents GROUP BY source),
frequent AS (
  SELECT l.source, l.norm, min(l.doc_id) AS carrier
  FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.norm, h.n
  HAVING count(DISTINCT (l.doc_id, l.text)) > 10 AND 100 * count(DISTINCT (l.doc_id, l.text)) > h.n
), lost AS (
  SELECT l.r, sum(len(string_split(l.norm, ' '))) AS n
  FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source
  WHERE l.doc_id IS DISTINCT FROM f.carrier GROUP BY l.r
), stats AS (
  SELECT d.doc_id, len(w.w) AS n_words,
    length(regexp_replace(d.t, '{_SPACE}', '', 'g')) AS word_chars,
    length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - lost_words) >= 30 * n_words AS kept, lost_words
FROM failed
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    {_words(_LOWER.format("coalesce(text, '')"), _NOT_WORD)} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    {_words(_LOWER.format("coalesce(text, '')"), _NOT_WORD)} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)
), hits AS (
  SELECT spots.r, spots.i, spots.size, windows.item
  FROM spots JOIN windows ON spots.g = windows.g AND spots.size = windows.size
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (r) LEFT JOIN items i USING (r)
"""


def _canonical(text: str) -> str:
    form = f"regexp_replace(coalesce({text}, ''), '\\r', chr(10), 'g')"
    form = f"regexp_replace({_LOWER.format(form)}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    form = f"' ' || trim(regexp_replace({form}, '{_NOT_WORD}', ' ', 'g')) || ' '"
    for spelling, usual in SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {usual} ')"
    return f"trim({form})"


def _licence_sql() -> str:
    values = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in LICENCE_TEXTS
    )
    return rf"""
WITH texts(licence, body) AS (VALUES {values}),
known AS (SELECT {_canonical('body')} AS form, min(licence) AS licence FROM texts GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
whole AS (SELECT r, doc_id, {_canonical('text')} AS form FROM d),
lines AS (
  SELECT DISTINCT r, {_canonical('line')} AS form
  FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)
), notices AS (
  SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(licence))), ',') AS names
  FROM lines JOIN known USING (form) GROUP BY r
)
SELECT doc_id, CASE WHEN w.form <> '' THEN sha256(w.form) END AS digest, k.licence,
  coalesce(n.n, 0) AS notice_lines, coalesce(n.names, '') AS notices
FROM whole w LEFT JOIN known k ON w.form = k.form AND w.form <> '' LEFT JOIN notices n USING (r)
"""


WARC = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages
), firsts AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM p LEFT JOIN firsts ON p.digest = firsts.digest AND p.size >= 100
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *,
    contains(role || text, '###') OR contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, ': ')
      OR regexp_matches(text, '\\[beh]') OR regexp_matches(role, '\\[behc]') AS conflict,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS safe_text,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') AS safe_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + CASE WHEN conflict THEN length(safe_role) + length(safe_text) ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's rounds, unrolled; every distance is worked out."""
    near = """
      SELECT r, k, d FROM (
        SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (
          SELECT r, k, CAST(list_sum(
            [CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT) for z in list_zip(v.c, o.c)]) AS BIGINT) AS d
          FROM v CROSS JOIN {centroids} o))
      WHERE place = 1"""
    means = """
      SELECT o.k, coalesce(m.c, o.c) AS c FROM {centroids} o LEFT JOIN (
        SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
          SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (
            SELECT k, unnest(c) AS x, generate_subscripts(c, 1) AS i
            FROM ({near}) a JOIN v USING (r))
          GROUP BY k, i)
        GROUP BY k) m USING (k)"""
    parts = [f"""
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, [CAST(floor(
        least(greatest(256 * CAST(x AS DOUBLE), -134217728), 134217728)) AS HUGEINT) for x in embedding] AS c
      FROM embeddings WHERE len(embedding) = 64
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
    ), k0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, c) - 1 AS k, c FROM v
      QUALIFY k < {k}
    )"""]
    for n in range(rounds):
        centroids = f"k{n}"
        chosen = near.format(centroids=centroids)
        parts.append(f"k{n + 1} AS MATERIALIZED ({means.format(centroids=centroids, near=chosen)})")
    return ", ".join(parts) + f""", last AS MATERIALIZED ({near.format(centroids=f"k{rounds}")})
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
      CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string([CAST(x AS VARCHAR) for x in o.c], ',')) AS centroid_sha256
    FROM last JOIN v USING (r) JOIN k{rounds} o USING (k)"""


def statements() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY,
        "op2_decontamination": DECONTAMINATION,
        "op4_licence_scan": _licence_sql(),
        "op5_warc_bundles": WARC,
        "op9_chat_formatting": CHAT,
        "op12_pivot_clusters": _clusters_sql(),
    }
