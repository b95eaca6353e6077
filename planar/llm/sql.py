"""DuckDB texts that compute the same rows as the queries."""

from __future__ import annotations

from planar.llm import mixing as ramps
from planar.llm import quality

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_rules() -> str:
    measure = {
        "n_words": "n_words",
        "repeat_pct": "100.0 * n_repeat_words / n_words",
        "mean_word_chars": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "stop_ratio": "n_stop_words / n_words",
        "echo_ratio": "n_echo_words / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
    }
    tests = [
        f"coalesce({measure[rule.measure]} {sign} {bound!r}, true)"
        for rule in quality.BASE_RULES + quality.METHOD_RULES
        for sign, bound in ((">=", rule.low), ("<=", rule.high))
        if bound is not None
    ]
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
spots AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win
          FROM d, unnest(range(1, len(words) - 6)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM spots) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM
            (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
echo AS (SELECT doc_id, count(*) AS n FROM
         (SELECT doc_id, words, unnest(range(2, len(words) + 1)) AS i FROM d) WHERE words[i] = words[i - 1] GROUP BY doc_id),
counts AS (
  SELECT d.doc_id,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: translate(l, {blanks}, '') <> '') AS lines,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda w: lower(w) IN ({_quoted(quality.STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    coalesce(echo.n, 0) AS n_echo_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN echo USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {' AND '.join(tests)} AS kept
FROM counts"""


def mixing() -> str:
    starts, ends = (", ".join(str(ramp[side]) for ramp in ramps.RAMPS) for side in (0, 1))

    def place(epoch: str) -> str:
        u = f"(least(CAST({epoch} * source_size + before AS DOUBLE) / target, 1.0) * (s + e) / 2)"
        return f"2 * {u} / (s + sqrt(greatest(s * s + 2 * (e - s) * {u}, 0.0)))"

    return f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
      FROM d GROUP BY source),
w AS (SELECT *, CAST(list_value(5, 2, 1)[(r - 1) % 3 + 1] AS BIGINT) AS w, 3 * source_size AS cap,
      CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS total FROM s),
l AS (SELECT *, (CAST(total AS DOUBLE) - CAST(sum(cap) OVER (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING) - cap AS BIGINT))
      / CAST(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
t AS (SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT first(level ORDER BY cap / w, r) FROM l WHERE level * w <= cap)) AS target
      FROM l),
b AS (SELECT d.doc_id, d.size, t.r, t.source_size, t.target,
      coalesce(sum(d.size) OVER (PARTITION BY t.r ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN
  CAST(least(greatest(floor((target - before - size / 2) / source_size) + 1, 0), 3) AS BIGINT) ELSE 0 END AS copies,
  CAST(list_value({starts})[(r - 1) % 3 + 1] AS DOUBLE) AS s, CAST(list_value({ends})[(r - 1) % 3 + 1] AS DOUBLE) AS e FROM b)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN {place('0')} ELSE -1.0 END AS first_position,
  CASE WHEN copies > 0 THEN {place('(copies - 1)')} ELSE -1.0 END AS last_position
FROM c"""


def warc() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f"""


# Levels of a tree in SQL, which has one step per level: 8 ** 9 leaves.
_LEVELS = 9


def _tree(name: str, nodes: str) -> str:
    """CTEs for the trees over ``nodes (g, i, h)``: ``{name}_top (g, top)`` and
    ``{name}_path (g, i, k, l, r)``, the siblings of node ``i`` of the first level at level ``k``."""
    steps = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM {nodes})"]
    steps += [
        f"{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM (SELECT g, i // 8 AS i, "
        f"sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k - 1} WHERE m > 1 GROUP BY ALL))"
        for k in range(1, _LEVELS + 1)
    ]
    run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
    sides = [
        f"SELECT *, {k} AS k, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
        f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE m > 1"
        for k in range(_LEVELS)
    ]
    steps.append(f"{name}_side AS ({' UNION ALL '.join(sides)})")
    tops = [f"SELECT g, h AS top FROM {name}{k} WHERE m = 1" for k in range(_LEVELS + 1)]
    steps.append(f"{name}_top AS ({' UNION ALL '.join(tops)})")
    steps.append(
        f"{name}_path AS (SELECT n.g, n.i, s.k, s.l, s.r FROM {name}0 n JOIN {name}_side s "
        f"ON s.g = n.g AND s.i = n.i // CAST(8 ** s.k AS BIGINT))")
    return ",\n".join(steps)


def merkle() -> str:
    def field(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bits = ", ".join(["CAST(0 AS UBIGINT)"] * 8)
    crc = (
        "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform("
        "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda c, b: list_reduce("
        f"list_prepend(xor(c, b), [{bits}]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))")
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS h,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} END AS forged FROM documents),
docs AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_tree('t', 'docs')},
subroots AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, top AS h, g AS lang_key FROM t_top),
{_tree('u', 'subroots')},
steps AS (SELECT g, i, 0 AS tree, k, l, r FROM t_path UNION ALL
  SELECT d.g, d.i, 1, p.k, p.l, p.r FROM docs d JOIN subroots s ON s.lang_key = d.g JOIN u_path p ON p.i = s.i),
proofs AS (SELECT g, i, list(struct_pack(l := l, r := r) ORDER BY tree, k) AS s FROM steps GROUP BY g, i)
SELECT doc_id, h AS leaf, t.top AS subroot, u.top AS root,
  sha256(array_to_string(list_transform(coalesce(s, []), lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(forged, h), list_transform(coalesce(s, []), lambda x: x.l || '|' || x.r)),
    lambda a, x: sha256(string_split(x, '|')[1] || a || string_split(x, '|')[2])) AS folded_root,
  folded_root = root AS verified
FROM docs JOIN t_top t USING (g) CROSS JOIN u_top u LEFT JOIN proofs USING (g, i)"""
