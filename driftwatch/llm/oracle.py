"""DuckDB SQL for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op7_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     w AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id, r) AS n FROM t)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM w
"""

ORACLE["op1_decontaminate"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
             FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT n FROM win),
     seen AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
            WHERE len(w) >= n),
     hit AS (SELECT r, i, n, item FROM seen JOIN win USING (n, g)),
     word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     item AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, items IS NOT NULL AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""

ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t), false) AS e
           FROM d),
     l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
     h AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
           FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
     one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
     o AS (SELECT v.k || w.k || x.k || y.k || z.k AS filter_order FROM one v, one w, one x, one y, one z
           WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
     s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k, left(filter_order, step - 1) AS before
           FROM o, unnest(range(1, 6)) AS t(step)),
     m AS (SELECT *, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed FROM h),
     r AS (SELECT part, filter_order, step, k, n, g, x, failed, contains(failed, k) AS now,
             failed <> translate(failed, before, '') AS gone FROM m, s),
     p AS (SELECT part, filter_order, step, k, sum(if(gone OR now, 0, n)) AS kept, sum(if(now AND NOT gone, n, 0)) AS removed,
             sum(if(now AND gone, n, 0)) AS redundant, sum(if(failed = k, n, 0)) AS unique_fails,
             sum(if(now AND NOT gone, g, 0)) AS good_lost, sum(if(now AND NOT gone, x, 0)) AS toxic_lost
           FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM p
"""
