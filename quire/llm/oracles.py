"""SQL of queries whose text is made from their parameters."""

from __future__ import annotations


def clustering(clusters: int, rounds: int, size: int, scale: int, salt: str) -> str:
    """Every round written out: nearest centroids by squared differences, then floors of the means."""
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {size}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS k, v
            FROM (SELECT v, sha256('{salt}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {clusters})
        )"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
            SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d, any_value(v) AS v FROM (
                SELECT x.vec_id, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                FROM kept x, c{n} c
            ) GROUP BY vec_id
        )""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
                SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v
                FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, {size + 1}) r(i) GROUP BY k, i) GROUP BY k
            ) m USING (k)
        )""")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c USING (k)
    """


def conversation_repair() -> str:
    """Damage, faults, and the edits found forwards: for each state the least `cost, then audit` as one string."""

    def more(value: str, cost: str, letter: str) -> str:
        return f"(lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{letter}')"

    def case(where: str, value: str) -> str:
        return f"CASE WHEN {where} THEN {value} END"

    # inserting before a row: a user row from 0, 1 and 3, an assistant row from 2
    closed = f"""SELECT *, least(b3, {more("n2", "5", "I")}) AS n3 FROM (
                SELECT *, least(b2, {", ".join(more(f"b{k}", "5", "I") for k in (0, 1, 3))}) AS n2 FROM dp)"""
    stays = "CASE WHEN x.fault = 'truncated' THEN 5 ELSE 0 END"
    kept = "x.fault IN ('none', 'truncated')"
    before = {0: "d.b0", 1: "d.b1", 2: "d.n2", 3: "d.n3"}
    steps = {k: [more(v, "2", "D")] for k, v in before.items()}
    steps[1].append(case(f"{kept} AND x.initial = 's'", more(before[0], stays, "K")))
    for source, target, letter in ((0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
        steps[target].append(case(f"{kept} AND x.initial = '{letter}'", more(before[source], stays, "K")))
        steps[target].append(case(kept, more(before[source], f"1 + {stays}", "R")))
    stepped = ", ".join(f"least({', '.join(v)}) AS b{k}" if len(v) > 1 else f"{v[0]} AS b{k}" for k, v in steps.items())
    return f"""
        WITH RECURSIVE coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) % 20 AS kind
            FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM coded, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)
        ), convs AS MATERIALIZED (
            SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
        ), numbered AS (
            SELECT c, turn, role, text, left(role, 1) AS initial,
                   row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
            FROM damaged d JOIN convs v ON d.conv_id IS NOT DISTINCT FROM v.conv_id
        ), x AS MATERIALIZED (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
                   initial <> '' AND lag(initial, 1, '') OVER w || initial IN ('su', 'ua', 'au') OR i = 1 AS legal,
                   count(*) OVER (PARTITION BY c) AS n
            FROM numbered WINDOW w AS (PARTITION BY c ORDER BY i)
        ), dp AS (
            SELECT c, 0::BIGINT AS i, repeat('0', 9) AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM convs
            UNION ALL
            SELECT d.c, x.i, {stepped} FROM ({closed}) d JOIN x ON x.c = d.c AND x.i = d.i + 1
        ), last AS MATERIALIZED (
            SELECT c, least(b0, n3) AS best FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1
        ), solved AS MATERIALIZED (
            SELECT c, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM last
        ), letters AS (
            SELECT c, j, substr(audit, j, 1) AS letter,
                   sum(CASE WHEN substr(audit, j, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS i
            FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
        ), lines AS (
            SELECT l.c, j, letter, x.role, x.initial, CASE WHEN letter = 'I' THEN '' ELSE x.text END AS text,
                   row_number() OVER (PARTITION BY l.c ORDER BY j) AS o
            FROM letters l LEFT JOIN x ON x.c = l.c AND x.i = l.i WHERE letter <> 'D'
        ), placed AS (
            SELECT *, max(CASE WHEN o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS lead FROM lines
        ), hashed AS (
            SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h
            FROM placed GROUP BY c
        ), counted AS (
            SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (NOT legal) AS illegal
            FROM x GROUP BY c
        )
        SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM convs v JOIN solved USING (c) LEFT JOIN counted USING (c) LEFT JOIN hashed USING (c)
    """
