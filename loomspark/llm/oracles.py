"""DuckDB SQL of the operators that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """op11: the rounds unrolled; every entry is compared, no pruning."""
    ctes = [
        f"""kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x AS c FROM cut WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min({{'d': {far}, 'k': k}}) AS best FROM cut JOIN b{r} USING (p) GROUP BY rid, p)")
        if r < rounds:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT p, best.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN cut USING (rid, p), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL)")
            ctes.append(f"m{r} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY p, k)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, k))")
    last = f"a{rounds}"
    ctes.append(f"coded AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM {last} GROUP BY rid)")
    ctes.append(f"books AS MATERIALIZED (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})")
    return f"""WITH {', '.join(ctes)}
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"""


def containment_sql(window: int = 10) -> str:
    """op12: windows of items joined with all word runs of documents of their lengths."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words.format(LOW.format("text"))} AS w FROM documents),
    it AS (SELECT item_id, {words.format(LOW.format("text"))} AS w FROM benchmark),
    win AS MATERIALIZED (
      SELECT DISTINCT item_id, array_to_string(w[i : i + {window - 1}], ' ') AS s, least(len(w), {window}) AS n
      FROM it, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
    spot AS (
      SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
      FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(i)),
    hit AS MATERIALIZED (SELECT rid, i, n, item_id FROM spot JOIN win USING (s, n)),
    covered AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) t(j) GROUP BY rid),
    named AS (
      SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def repair_sql() -> str:
    """op13: one recursion over the rows of all conversations; repaired texts grow along with the edits."""
    return r"""
    WITH RECURSIVE crc_table AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    fate AS MATERIALIZED (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
      FROM conversations, crc_table),
    hurt AS (
      SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM fate, range(2) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
    conv AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
    placed AS MATERIALIZED (
      SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
        trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
      FROM hurt JOIN conv ON hurt.conv_id IS NOT DISTINCT FROM conv.conv_id),
    judged AS MATERIALIZED (
      SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before
      FROM placed),
    stats AS (
      SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
      FROM judged GROUP BY c),
    -- states: - nothing yet, s, u, a; what insertions alone lead to
    added(f, g, letters, lines) AS (VALUES ('-', '-', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''),
      ('-', 'u', 'I', 'user:' || chr(10)), ('s', 'u', 'I', 'user:' || chr(10)), ('a', 'u', 'I', 'user:' || chr(10)), ('u', 'a', 'I', 'assistant:' || chr(10)),
      ('-', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
    follow(g, h, role) AS (VALUES ('-', 's', ''), ('-', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
    done AS MATERIALIZED (
      SELECT c, i, fault, g, h, letter, cost, line FROM (
        SELECT c, i, fault, g, h, 'K' AS letter, 0 AS cost, j.role || ':' || text || chr(10) AS line FROM judged j JOIN follow ON h = left(j.role, 1) WHERE fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT c, i, fault, g, h, 'R', 3, follow.role || ':' || text || chr(10) FROM judged j, follow WHERE h <> 's' AND fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT c, i, '', g, g, 'D', 4, '' FROM judged j, (VALUES ('-'), ('s'), ('u'), ('a')) s(g))),
    walk(c, i, state, cost, audit, lines) AS (
      SELECT c, 1::BIGINT, '-', 0::BIGINT, '', '' FROM conv
      UNION ALL
      SELECT c, i, h, best.cost, best.audit, best.lines FROM (
        SELECT w.c, w.i + 1 AS i, d.h, min({'cost': w.cost + 3 * len(a.letters) + d.cost + CASE WHEN d.fault = 'truncated' THEN 3 ELSE 0 END,
          'audit': w.audit || a.letters || d.letter, 'lines': w.lines || a.lines || d.line}) AS best
        FROM walk w JOIN added a ON a.f = w.state JOIN done d ON d.c = w.c AND d.i = w.i AND d.g = a.g GROUP BY w.c, w.i, d.h)),
    closed AS (
      SELECT w.c, min({'cost': cost + 3 * len(a.letters), 'audit': audit || a.letters, 'lines': w.lines || a.lines}) AS best
      FROM walk w LEFT JOIN stats USING (c) JOIN added a ON a.f = w.state WHERE w.i = coalesce(n, 0) + 1 AND a.g IN ('-', 'a') GROUP BY w.c)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(left(best.lines, greatest(len(best.lines) - 1, 0))) AS repaired_sha256
    FROM conv JOIN closed USING (c) LEFT JOIN stats USING (c)"""
