"""DuckDB SQL for the operators that SQL can express."""

HAMMING_TOP_K = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, v.embedding),
              lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM pairs
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE rk <= 10
"""

HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM usable a, usable c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""

_WHITE = r"[^\x20\x09-\x0D]"


def _row(x: str, more: str, cost: str, op: str, line: str) -> str:
    """A state after one more edit: (cost, audit, repaired rows), null where it is out of reach."""
    return f"CASE WHEN {x} IS NOT NULL{more} THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{op}', 't': {x}.t || {line}}} END"


def conversation_repair() -> str:
    """The DP row by row: x0 to x3 are the states (nothing yet, after system, user, assistant)
    before a row, y0 to y3 after any insertions, each the least (cost, audit)."""
    user, assistant, none = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "''"
    insert = lambda x, line: _row(x, "", "5", "I", line)
    closed = f"""least(x2, {insert("x0", user)}, {insert("x1", user)}, {insert("x3", user)})"""
    drop = lambda y: _row(y, "", "2", "D", none)

    def stay(y: str, initial: str, role: str) -> str:
        kept = _row(y, f" AND NOT gone AND left(role, 1) = '{initial}'", "late", "K", "chr(10) || role || ':' || text")
        recast = _row(y, f" AND NOT gone AND left(role, 1) <> '{initial}'", "late + 1", "R", f"chr(10) || '{role}:' || text")
        return f"{kept}, {recast}" if role else kept

    return rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) % 20 AS k
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base, LATERAL (SELECT unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
    regexp_extract(text, '({_WHITE})[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_WHITE}') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(last, '[.!?]') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos
  FROM seen
), lines AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
  FROM lines GROUP BY conv_id
), convs AS (SELECT DISTINCT conv_id FROM conversations
), steps AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS x0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS x1,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS x2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS x3 FROM convs
  UNION ALL
  SELECT conv_id, pos, {drop("y0")}, least({drop("y1")}, {stay("y0", "s", "")}),
    least({drop("y2")}, {stay("y0", "u", "user")}, {stay("y1", "u", "user")}, {stay("y3", "u", "user")}), least({drop("y3")}, {stay("y2", "a", "assistant")})
  FROM (
    SELECT z.conv_id, l.pos, role, text, gone, late, y0, y1, y2, least(x3, {insert("y2", assistant)}) AS y3
    FROM (SELECT *, x0 AS y0, x1 AS y1, {closed} AS y2 FROM steps) z JOIN lines l ON l.conv_id IS NOT DISTINCT FROM z.conv_id AND l.pos = z.pos + 1)
), ends AS (
  SELECT s.conv_id, least(x0, x3, {insert("y2", assistant)}) AS best
  FROM (SELECT *, {closed} AS y2 FROM steps) s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.pos = coalesce(c.n, 0)
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


CONVERSATION_REPAIR = conversation_repair()

CHAT_WINDOWS = r"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), lines AS (
  SELECT *, '<|turn|>' || replace(replace(role, '\', '\b'), '<', '\l') || '<|text|>' || replace(replace(text, '\', '\b'), '<', '\l') || '<|end|>' || chr(10) AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM turns
), sized AS (  -- the control strings and the line feed are 24 bytes and count as 4 tokens
  SELECT *, strlen(line) - 20 AS tok, pos = 1 AND role = 'system' AS opens FROM lines
), summed AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, sum(CASE WHEN opens THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM sized
), spans AS (
  SELECT *, (upto - tok) // greatest(1, 2304 - sys) AS starts, (upto - 1) // greatest(1, 2304 - sys) AS ends FROM summed
), windows AS (  -- turns within one span together, a turn that crosses the end of its span alone
  SELECT conv_id, starts, starts < ends AS alone, min(pos) AS first_pos, min(upto - tok) AS first_before, sum(length(line)) AS own_chars,
         3072 - sum(tok) - CASE WHEN bool_or(opens) THEN 0 ELSE any_value(sys) END AS spare
  FROM spans GROUP BY ALL
), shown AS (
  SELECT w.conv_id, w.own_chars + coalesce((SELECT sum(length(s.line)) FROM spans s
    WHERE s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos < w.first_pos AND w.spare >= 0
      AND (s.opens OR w.first_before - (s.upto - s.tok) <= least(768, w.spare))), 0) AS chars
  FROM windows w
), sizes AS (
  SELECT conv_id, sum(chars) AS chars FROM shown GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
         string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos) AS loss
  FROM lines GROUP BY conv_id
)
SELECT w.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM whole w JOIN sizes s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def mixing(alpha: float = 0.9, rounds: int = 40, seed: int = 20, shortfall: float = 0.005) -> str:
    """The raking written out, one materialised step for each round and dimension; more
    rounds than it takes to settle."""
    dims = ["source", "lang", "topic"]
    steps = [
        r"""rows_ AS MATERIALIZED (
  SELECT doc_id, source, lang,
    CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN contains(lower(text), 'license') THEN 'legal'
         WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact'
         WHEN contains(text, ' = ') THEN 'code' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
  FROM documents)""",
        """cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM rows_ WHERE n_tokens > 0 GROUP BY ALL)""",
    ]
    targets = ", ".join(f"(SELECT t.s FROM tempered_{d} t WHERE t.v IS NOT DISTINCT FROM c.{d}) AS t_{d}" for d in dims)
    for d in dims:
        steps.append(f"tempered_{d} AS MATERIALIZED (SELECT {d} AS v, pow(sum(mass), {alpha}) / sum(pow(sum(mass), {alpha})) OVER () AS s FROM cells GROUP BY {d})")
    steps.append(f"f0 AS MATERIALIZED (SELECT c.*, (SELECT sum(mass) FROM cells) AS total, 1.0::DOUBLE AS factor, {targets} FROM cells c)")
    k = 0
    for _ in range(rounds):
        for d in dims:
            steps.append(f"f{k + 1} AS MATERIALIZED (SELECT * REPLACE (factor * t_{d} * total / sum(factor * mass) OVER (PARTITION BY {d}) AS factor) FROM f{k})")
            k += 1
    steps.append(f"stepped AS MATERIALIZED (SELECT floor(log2(factor) * 16) AS step, sum(factor * mass / total) AS share, max(factor) AS most FROM f{k} GROUP BY 1)")
    steps.append("above AS MATERIALIZED (SELECT most, sum(share) OVER (ORDER BY step DESC) AS upto FROM stepped)")
    steps.append(f"scaled AS MATERIALIZED (SELECT *, least(1.0, factor * least(1.0, (SELECT 1 / max(most) FROM above WHERE upto > {shortfall}))) AS prob FROM f{k})")
    shares = ", ".join(f"abs(sum(prob * mass) OVER (PARTITION BY {d}) / sum(prob * mass) OVER () - t_{d})" for d in dims)
    steps.append(f"fitted AS MATERIALIZED (SELECT *, greatest({shares}) AS residual FROM scaled)")
    steps.append(
        f"""judged AS (SELECT r.*, CASE WHEN r.n_tokens > 0 THEN f.prob ELSE 0.0 END AS p, t_source, t_lang, t_topic, residual,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(r.doc_id AS VARCHAR), 'null') || '|{seed}'), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM rows_ r LEFT JOIN fitted f ON r.source IS NOT DISTINCT FROM f.source AND r.lang IS NOT DISTINCT FROM f.lang AND r.topic = f.topic)"""
    )
    more = ", ".join(f"round({c}, 9) AS {c}" for c in ("t_source", "t_lang", "t_topic", "residual"))
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(p, 9) AS prob, u, u < p AS sampled, {more} FROM judged"
