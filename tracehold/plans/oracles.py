"""SQL equivalents of the registered queries, for DuckDB over the same tables.

Written apart from the DataFrame code: ancestry, for example, joins out all rows
and ranks them, where the Spark side never builds them; the fit is written out epoch by epoch.
"""

from __future__ import annotations

import hashlib

import numpy as np

from tracehold.operators import prompts

_LOGS = """
raw AS (
  SELECT event_id AS pos, epoch_us(ts) AS us, user_id AS u, event_type AS e,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
logs AS (
  SELECT pos, us, us * 1000 AS timestamp_ns, k / 100.0 AS base,
    CASE e WHEN 'signup' THEN 'EVENT_FORK' WHEN 'click' THEN 'EVENT_OPEN'
           WHEN 'purchase' THEN 'EVENT_WRITE' WHEN 'view' THEN 'EVENT_CONNECT'
           WHEN 'error' THEN 'EVENT_MMAP' END AS event_type,
    CAST(u AS VARCHAR) AS process_id,
    CASE WHEN u < 5 OR k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'None'
         WHEN k % 10 = 2 THEN CAST(9000 + u % 7 AS VARCHAR)
         WHEN k % 10 = 3 THEN CAST((u * 7 + 3) % 15 AS VARCHAR)
         ELSE CAST(u // 3 AS VARCHAR) END AS parent_process_id,
    CASE k % 8 WHEN 0 THEN 'bash' WHEN 1 THEN 'sshd' WHEN 2 THEN 'python3' WHEN 3 THEN 'curl'
               WHEN 4 THEN 'ls' WHEN 5 THEN 'tsm' WHEN 6 THEN 'cron' END AS process_name,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
         ELSE '-c ' || CASE k % 7 WHEN 0 THEN 'wget x' WHEN 1 THEN 'sync' ELSE 'run' END
    END AS args,
    CAST(1000 + u % 5 AS VARCHAR) AS user_id,
    CASE WHEN e IN ('click', 'purchase', 'error') AND k % 5 <> 0
         THEN '/var/f' || CAST(k % 20 AS VARCHAR) END AS file_path,
    CASE WHEN e = 'view' AND k % 4 <> 0 THEN '10.0.0.' || CAST(k % 16 AS VARCHAR) END AS remote_ip,
    CASE WHEN e = 'view' AND k % 3 <> 0 THEN CAST(1000 + k AS VARCHAR) END AS remote_port,
    CASE WHEN k >= 80 THEN 1 ELSE 0 END AS is_suspicious,
    CASE WHEN k >= 90 THEN 1 ELSE 0 END AS is_evil
  FROM raw
),
named AS (
  SELECT *, coalesce(args, process_name, 'unknown') AS cmd,
    CASE WHEN parent_process_id IN ('null', 'None') THEN NULL ELSE parent_process_id END AS parent
  FROM logs
)"""

_GRAPH = _LOGS + """,
edges AS (SELECT DISTINCT parent AS src, process_id AS dst FROM named WHERE parent IS NOT NULL),
own AS (SELECT process_id AS id, arg_max(cmd, pos) AS cmd_line FROM named GROUP BY 1),
nodes AS (
  SELECT id, cmd_line FROM own
  UNION ALL
  SELECT DISTINCT src, CAST(NULL AS VARCHAR) FROM edges WHERE src NOT IN (SELECT id FROM own)
)"""

_ANCESTRY = _GRAPH + """,
paths AS (
  SELECT n.id, n.cmd_line, p.id AS parent_id, p.cmd_line AS parent_cmd,
         g.id AS gp_id, g.cmd_line AS gp_cmd,
         row_number() OVER (PARTITION BY n.id ORDER BY p.id NULLS LAST, g.id NULLS LAST) AS place
  FROM nodes n
  LEFT JOIN edges e1 ON e1.dst = n.id LEFT JOIN nodes p ON p.id = e1.src
  LEFT JOIN edges e2 ON e2.dst = p.id LEFT JOIN nodes g ON g.id = e2.src
),
chain AS (SELECT * FROM paths WHERE place = 1),
short AS (
  SELECT id, 'Grandparent: ' || coalesce(nullif(gp_cmd, ''), 'None') || chr(10)
    || '  └── Parent: ' || coalesce(nullif(parent_cmd, ''), 'Unknown') || chr(10)
    || '        └── Target: ' || coalesce(nullif(cmd_line, ''), 'Unknown') AS context
  FROM chain
)"""

_TOUCHED = """,
touched AS (
  SELECT DISTINCT process_id AS id, 'file' AS kind, file_path AS name FROM named
  WHERE file_path IS NOT NULL AND event_type IN ('EVENT_OPEN', 'EVENT_WRITE',
        'EVENT_MODIFY_FILE_ATTRIBUTES', 'openat', 'security_file_open')
  UNION ALL
  SELECT DISTINCT process_id, 'ip', coalesce(remote_ip, 'LOCAL_SOCKET') FROM named
  WHERE remote_ip IS NOT NULL OR event_type IN ('EVENT_CONNECT', 'EVENT_ACCEPT', 'socket', 'connect')
),
artifacts AS (
  SELECT id,
    (list(name ORDER BY name) FILTER (kind = 'file'))[1:5] AS files,
    (list(name ORDER BY name) FILTER (kind = 'ip'))[1:3] AS ips,
    count(*) FILTER (kind = 'file') AS file_count,
    count(*) FILTER (kind = 'ip') AS ip_count
  FROM touched GROUP BY id
)"""

_LONG = """,
long AS (
  SELECT c.id, '--- EXECUTION CHAIN ---' || chr(10)
    || 'Grandparent Process: ' || coalesce(nullif(gp_cmd, ''), 'Unknown') || chr(10)
    || '  └── Spawned Parent: ' || coalesce(nullif(parent_cmd, ''), 'Unknown') || chr(10)
    || '        └── Spawned Target: ' || coalesce(nullif(cmd_line, ''), 'Unknown') || chr(10)
    || chr(10) || '--- ARTIFACTS TOUCHED ---' || chr(10)
    || 'Files: ' || CASE WHEN len(a.files) > 0 THEN array_to_string(a.files, ', ') ELSE 'None' END || chr(10)
    || 'Network IPs: ' || CASE WHEN len(a.ips) > 0 THEN array_to_string(a.ips, ', ') ELSE 'None' END
    AS context
  FROM chain c LEFT JOIN artifacts a ON a.id = c.id
)"""

_INDEX = _GRAPH + """,
idx AS (SELECT id, cmd_line, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes),
pairs AS (
  SELECT s.idx AS src, d.idx AS dst
  FROM edges e JOIN idx s ON s.id = e.src JOIN idx d ON d.id = e.dst
),
looped AS (
  SELECT src, dst FROM pairs WHERE src <> dst UNION ALL SELECT idx, idx FROM idx
),
degree AS (SELECT dst AS idx, count(*) AS degree FROM looped GROUP BY dst)"""

_NESTED = _LOGS + """,
kept AS (
  SELECT * FROM named
  WHERE pos % 11 <> 0 AND event_type IN ('EVENT_EXECUTE', 'EVENT_FORK', 'EVENT_CLONE',
    'EVENT_CONNECT', 'EVENT_ACCEPT', 'EVENT_SENDTO', 'EVENT_RECVFROM', 'EVENT_OPEN',
    'EVENT_WRITE', 'EVENT_MODIFY_FILE_ATTRIBUTES')
),
flat AS (
  SELECT pos, CASE WHEN pos % 13 <> 0 THEN timestamp_ns ELSE 0 END AS timestamp_ns, event_type,
    CASE WHEN pos % 17 <> 0 THEN process_id ELSE 'UNKNOWN' END AS thread_id,
    CASE WHEN pos % 19 <> 0 THEN args END AS cmd_line, file_path,
    CASE WHEN pos % 19 <> 0 THEN remote_ip END AS remote_ip,
    CASE WHEN pos % 19 <> 0 THEN remote_port END AS remote_port
  FROM kept
)"""

_SPLIT = """CASE WHEN pos % 41 IN (1, 2, 3, 4, 5) THEN 'Training'
  WHEN pos % 41 IN (15, 16, 17, 18, 19) THEN 'Validation'
  WHEN pos % 41 IN (35, 36, 37, 38, 39) THEN 'Testing' END AS split"""

_LABELLED = """
  SELECT {keys} CAST(us AS DOUBLE) AS timestamp,
    CASE WHEN pos % 31 = 0 OR pos % 37 = 0 THEN NULL ELSE event_type END AS event_type,
    process_id AS thread_id, process_id, parent_process_id,
    nullif(coalesce(process_name, '') || CASE WHEN pos % 41 = 0 THEN ', "x"' ELSE '' END, '') AS cmd_line,
    user_id, '0' AS return_value, is_suspicious, is_evil
  FROM named
  WHERE pos % 23 <> 0 AND pos % 29 <> 0 AND pos % 43 <> 0 AND pos % 47 <> 0"""

_SCORED = _LOGS + """,
risk AS (
  SELECT *, lower(coalesce(args, '')) || ' | ' || lower(coalesce(process_name, '')) AS hay FROM named
),
scored AS (
  SELECT *, least(0.99, base + CASE WHEN risky THEN 0.90 ELSE 0.0 END) AS score
  FROM (
    SELECT *, hay LIKE '%tsm%' OR hay LIKE '%sshd%' OR hay LIKE '%wget%' OR hay LIKE '%curl%'
      OR hay LIKE '%chmod%' OR hay LIKE '%nc%' OR hay LIKE '%bash -i%' AS risky
    FROM risk
  )
),
alerted AS (SELECT * FROM scored WHERE score > 0.85)"""

_LINES = """pos, process_id,
  substring(coalesce(nullif(args, ''), 'unknown'), 1, 30) AS shown_cmd,
  printf('%.2f', score) AS score_text"""

_ANSWERS = """
answers AS (
  SELECT doc_id, 'm' || CAST(m AS VARCHAR) AS model, toxic AS is_evil,
    CASE (doc_id * 3 + m + toxic) % 4 WHEN 0 THEN 'Benign activity.'
      WHEN 1 THEN 'Verdict: MALICIOUS. T1059.' WHEN 2 THEN 'malicious, not benign'
      ELSE 'inconclusive' END AS text,
    CASE WHEN (doc_id + m) % 29 = 0 THEN 'timeout' END AS error
  FROM labels CROSS JOIN (SELECT unnest([0, 1, 2]) AS m)
),
graded AS (
  SELECT *, CASE WHEN predicted AND is_evil = 1 THEN 'TP' WHEN predicted THEN 'FP'
      WHEN NOT predicted AND is_evil = 1 THEN 'FN' WHEN NOT predicted THEN 'TN' END AS outcome
  FROM (
    SELECT *, CASE WHEN error IS NULL
      THEN contains(lower(text), 'malicious') AND NOT contains(lower(text), 'benign') END AS predicted
    FROM answers
  )
)"""


def _counts(rows: str, by: str = "", extra: str = "") -> str:
    return f"""counts AS (
  SELECT {by + ',' if by else ''} count(*) FILTER (outcome = 'TP') AS tp,
    count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn,
    count(*) FILTER (outcome = 'FN') AS fn, count(*) AS n {extra}
  FROM {rows} {'GROUP BY ' + by if by else ''}
),
shares AS (
  SELECT *, CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS a,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
  FROM counts
),
metrics AS (
  SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM shares
)"""


def _metric_columns(scale: str) -> str:
    return ", ".join(
        f"round({short} * {scale}, 6) AS {name}"
        for short, name in (("a", "accuracy"), ("p", "precision"), ("r", "recall"), ("f", "f1"))
    )


def _seed(text: str) -> str:
    hashed = f"sha256(coalesce(nullif({text}, ''), 'unknown'))"
    return (
        "list_reduce(list_transform(range(0, 8), lambda i: "
        f"('0x' || substr({hashed}, (i * 8 + 1)::INT, 8))::BIGINT), "
        "lambda a, x: (a * 4294967296 + x) % 100000, 0::BIGINT)"
    )


def _draw(label: str, modulus: str) -> str:
    return f"('0x' || substr(sha256('{label}:' || CAST(slot AS VARCHAR)), 1, 13))::BIGINT % {modulus}"


# Feature vectors of the seeds in table ``seeds``: the generator's first draws, step by
# step. State word i follows from word i-1; the first 16 outputs need words 0 to 412.
_DRAWS = """
state AS (
  SELECT seed, 0 AS i, seed AS word FROM seeds
  UNION ALL
  SELECT seed, i + 1, (1812433253 * xor(word, word >> 30) + i + 1) & 4294967295
  FROM state WHERE i < 412
),
words AS (SELECT seed, list(word ORDER BY i) AS w FROM state GROUP BY seed),
mixed AS (
  SELECT seed, list_transform(range(1, 17), lambda k:
    xor(xor(w[k + 397], ((w[k] & 2147483648) | (w[k + 1] & 2147483647)) >> 1),
        CASE WHEN w[k + 1] % 2 = 1 THEN 2567483615 ELSE 0 END)) AS v FROM words
),
tempered1 AS (SELECT seed, list_transform(v, lambda y: xor(y, y >> 11)) AS v FROM mixed),
tempered2 AS (SELECT seed, list_transform(v, lambda y: xor(y, (y << 7) & 2636928640)) AS v FROM tempered1),
tempered3 AS (SELECT seed, list_transform(v, lambda y: xor(y, (y << 15) & 4022730752)) AS v FROM tempered2),
vectors AS (
  SELECT seed, list_transform(v, lambda y: (xor(y, y >> 18) & 16777215) / 16777216.0::DOUBLE) AS x
  FROM tempered3
)"""


def _numbers(values: np.ndarray) -> str:
    return "[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in values) + "]"


def _matrix(columns: np.ndarray) -> str:
    return "[" + ", ".join(_numbers(c) for c in columns) + "]"


def _negatives(label: str) -> str:
    """Table ``non_edges`` (src, dst): as many sampled non-edges as there are edges."""
    return f"""
size AS (SELECT (SELECT count(*) FROM idx) AS n, (SELECT count(*) FROM pairs) AS e),
slots AS (
  SELECT unnest(range(0, CAST(floor(-n * n * ln(1.0 - least(0.95::DOUBLE,
    1.1::DOUBLE * e / greatest(n * (n - 1) - e, 1)))) AS BIGINT) + 64)) AS slot, n
  FROM size
),
drawn AS (SELECT {_draw(label + ':src', 'n')} AS src, {_draw(label + ':dst', 'n')} AS dst, slot FROM slots),
fresh AS (
  SELECT src, dst, min(slot) AS slot FROM drawn d
  WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.src = d.src AND p.dst = d.dst)
  GROUP BY src, dst
),
non_edges AS (
  SELECT src, dst FROM fresh QUALIFY row_number() OVER (ORDER BY slot) <= (SELECT e FROM size)
)"""


# Free pairs of the square of events, numbered by (src, dst).
_DENSE = """
width AS (SELECT CAST(floor(sqrt(coalesce(max(event_id), 0))) AS BIGINT) + 1 AS n FROM events),
dense AS (SELECT DISTINCT event_id // n AS src, event_id % n AS dst FROM events, width WHERE (user_id * 7 + event_id) % 9 <> 0),
ends AS (SELECT unnest(range(0, n)) AS node FROM width),
free AS (
  SELECT s.node AS src, t.node AS dst, row_number() OVER (ORDER BY s.node, t.node) - 1 AS rank
  FROM ends s, ends t WHERE s.node <> t.node AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.src = s.node AND d.dst = t.node)
)"""


# Nodes of five loads (by pos % 5), numbered load by load in id order.
_NUMBERED = _GRAPH + """,
born AS (
  SELECT id, min(load) AS load FROM (
    SELECT process_id AS id, pos % 5 AS load FROM named
    UNION ALL SELECT parent, pos % 5 FROM named WHERE parent IS NOT NULL
  ) GROUP BY id
),
numbered AS (
  SELECT id, cmd_line, row_number() OVER (ORDER BY load, id) - 1 AS idx FROM nodes JOIN born USING (id)
)"""


def _figures(bad: str, errors: bool) -> str:
    """Counts of a scoring run in which the logs that ``bad`` tells cannot be read."""
    read = [("read", "records", "count_if(NOT bad)"), ("read", "errors", "count_if(bad)"), ("parse", "rejected", "count(*) * 0")] if errors else [
        ("read", "records", "count(*)"), ("parse", "rejected", "count_if(bad)")]
    rows = [*read, ("logs", "logs", "count_if(NOT bad)"), ("logs", "malicious", "count_if(NOT bad AND is_evil = 1)"),
            ("logs", "benign", "count_if(NOT bad AND is_evil = 0)"),
            ("score", "alerts", "count_if(NOT bad AND (risky OR is_evil = 1))"), ("run", "seconds", "count(*) * 0 + 1")]
    tables = " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{name}' AS measure, CAST({value} AS BIGINT) AS value FROM seen"
                                for stage, name, value in rows)
    return f"WITH {_SCORED}, seen AS (SELECT *, {bad} AS bad FROM scored) {tables}"


def _ranks(wanted: str) -> str:
    """Table ``ranks`` (rank): so many drawn ranks of the free pairs."""
    return f"""
room AS (SELECT total, {wanted} AS wanted FROM (SELECT count(*) AS total FROM free)),
slots AS (
  SELECT unnest(range(0, CAST(floor(-total * ln(1 - 1.1::DOUBLE * wanted / total)) AS BIGINT) + 64)) AS slot, total FROM room
),
ranks AS (
  SELECT rank FROM (SELECT {_draw('dense:rank', 'total')} AS rank, min(slot) AS slot FROM slots GROUP BY 1)
  QUALIFY row_number() OVER (ORDER BY slot) <= (SELECT wanted FROM room)
)"""


def _initial_matrices() -> tuple[np.ndarray, np.ndarray]:
    """Glorot-uniform 16 x 32 and 32 x 16, drawn one after the other from one seeded stream."""
    stream = np.random.Generator(np.random.PCG64(0))
    return tuple(stream.random((rows, columns)) * 2 * (6 / 48) ** 0.5 - (6 / 48) ** 0.5 for rows, columns in ((16, 32), (32, 16)))


def _weights() -> str:
    """The initial weight matrices by column; initial biases are zero."""
    w1, w2 = _initial_matrices()
    return f"""weights AS (SELECT {_matrix(w1.T)} AS w1, {_matrix(w2.T)} AS w2,
  {_numbers(np.zeros(32))} AS b1, {_numbers(np.zeros(16))} AS b2)"""


def _fitted_weights(epochs: int) -> str:
    """The weights after so many epochs."""
    matrix = f"(SELECT list(c ORDER BY i) FROM (SELECT i, list(w ORDER BY j) AS c FROM at{epochs} WHERE name = '%s' GROUP BY i))"
    vector = f"(SELECT list(w ORDER BY i) FROM at{epochs} WHERE name = '%s')"
    return f"""weights AS (
  WITH RECURSIVE {_INDEX}, {_embeddings()}, {_fit(epochs)}
  SELECT {matrix % 'w1'} AS w1, {matrix % 'w2'} AS w2, {vector % 'b1'} AS b1, {vector % 'b2'} AS b2
)"""


def _fit(epochs: int) -> str:
    """Losses of full-batch Adam steps, forward and backward written out: one set of tables per epoch."""
    w1, w2 = _initial_matrices()
    ks, ls = "(SELECT unnest(range(1, 33)) AS k)", "(SELECT unnest(range(1, 17)) AS l)"
    parts = [f"""
at0 AS (
  SELECT name, i, j, CASE name WHEN 'w1' THEN {_matrix(w1.T)}[i][j] WHEN 'w2' THEN {_matrix(w2.T)}[i][j] ELSE 0.0::DOUBLE END AS w,
    0.0::DOUBLE AS m, 0.0::DOUBLE AS v
  FROM (SELECT 'w1' AS name, k AS i, l AS j FROM {ks}, {ls} UNION ALL SELECT 'w2', l, k FROM {ks}, {ls}
        UNION ALL SELECT 'b1', k, 1 FROM {ks} UNION ALL SELECT 'b2', l, 1 FROM {ls})
)"""]
    for e in range(1, epochs + 1):
        matrix = f"(SELECT list(c ORDER BY i) FROM (SELECT i, list(w ORDER BY j) AS c FROM at{e - 1} WHERE name = '%s' GROUP BY i))"
        vector = f"(SELECT list(w ORDER BY i) FROM at{e - 1} WHERE name = '%s')"
        parts.append(f"""
now{e} AS (SELECT {matrix % 'w1'} AS w1, {matrix % 'w2'} AS w2, {vector % 'b1'} AS b1, {vector % 'b2'} AS b2),
first{e} AS (SELECT idx, x, w2, list_transform(range(1, 33), lambda k: list_dot_product(x, w1[k]) + b1[k]) AS s FROM spread, now{e}),
hidden{e} AS (SELECT *, list_transform(s, lambda a: greatest(a, 0)) AS h FROM first{e}),
middle{e} AS (SELECT idx, list_transform(w2, lambda c: list_dot_product(h, c)) AS x FROM hidden{e}),
summed{e} AS {_spread(f'middle{e}')},
z{e} AS (SELECT idx, list_transform(range(1, 17), lambda l: x[l] + b2[l]) AS z FROM summed{e}, now{e}),
non{e} AS (WITH {_negatives(f'0:{e}')} SELECT src, dst FROM non_edges),
scored{e} AS (
  SELECT src, dst, y, s.z AS zs, d.z AS zd, list_dot_product(s.z, d.z) AS score, count(*) OVER (PARTITION BY y) AS n
  FROM (SELECT src, dst, 1.0::DOUBLE AS y FROM pairs UNION ALL SELECT src, dst, 0.0 FROM non{e})
  JOIN z{e} s ON s.idx = src JOIN z{e} d ON d.idx = dst
),
loss{e} AS (SELECT sum((greatest(score, 0.0) + ln(1 + exp(-abs(score))) - y * score) / n) AS loss FROM scored{e}),
pulled{e} AS (SELECT *, (1 / (1 + exp(-score)) - y) / n AS pull FROM scored{e}),
back{e} AS (
  SELECT idx, l, sum(g) AS g FROM (
    SELECT src AS idx, l, pull * zd[l] AS g FROM pulled{e}, {ls} UNION ALL SELECT dst, l, pull * zs[l] FROM pulled{e}, {ls}
  ) GROUP BY idx, l
),
returned{e} AS (
  SELECT idx, list(q ORDER BY l) AS q FROM (
    SELECT e.src AS idx, l, sum(g / sqrt(CAST(s.degree * d.degree AS DOUBLE))) AS q
    FROM looped e JOIN degree s ON s.idx = e.src JOIN degree d ON d.idx = e.dst JOIN back{e} b ON b.idx = e.dst GROUP BY e.src, l
  ) GROUP BY idx
),
slope{e} AS (
  SELECT x, h, q, list_transform(range(1, 33), lambda k: CASE WHEN s[k] > 0 THEN
    list_sum(list_transform(range(1, 17), lambda l: q[l] * w2[l][k])) ELSE 0 END) AS ds FROM hidden{e} JOIN returned{e} USING (idx)
),
grads{e} AS (
  SELECT 'w1' AS name, k AS i, l AS j, sum(x[l] * ds[k]) AS g FROM slope{e}, {ks}, {ls} GROUP BY k, l
  UNION ALL SELECT 'w2', l, k, sum(h[k] * q[l]) FROM slope{e}, {ks}, {ls} GROUP BY k, l
  UNION ALL SELECT 'b1', k, 1, sum(ds[k]) FROM slope{e}, {ks} GROUP BY k
  UNION ALL SELECT 'b2', l, 1, sum(g) FROM back{e} GROUP BY l
),
moved{e} AS (
  SELECT name, i, j, w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM at{e - 1} JOIN grads{e} USING (name, i, j)
),
at{e} AS (
  SELECT name, i, j, w - 0.01 * (m / (1 - 0.9 ** {e})) / (sqrt(v / (1 - 0.999 ** {e})) + 1e-8) AS w, m, v FROM moved{e}
)""")
    return ",".join(parts)


def _spread(rows: str) -> str:
    """One propagation round over the vectors ``x`` of ``rows``: (idx, x)."""
    return f"""(
  SELECT idx, list(v ORDER BY k) AS x FROM (
    SELECT l.dst AS idx, k, sum(r.x[k] / sqrt(CAST(s.degree * d.degree AS DOUBLE))) AS v
    FROM looped l JOIN degree s ON s.idx = l.src JOIN degree d ON d.idx = l.dst
    JOIN {rows} r ON r.idx = l.src, (SELECT unnest(range(1, 17)) AS k)
    GROUP BY l.dst, k
  ) GROUP BY idx
)"""


def _embeddings() -> str:
    """Table ``embedded`` (idx, x): two propagation rounds with the layers between."""
    return f"""
seeded AS (SELECT idx, {_seed('cmd_line')} AS seed FROM idx),
seeds AS (SELECT DISTINCT seed FROM seeded), {_DRAWS}, {_weights()},
features AS (SELECT idx, x FROM seeded JOIN vectors USING (seed)),
spread AS {_spread('features')},
hidden AS (
  SELECT idx, w2, list_transform(w1, lambda a: greatest(list_dot_product(x, a), 0)) AS h
  FROM spread, weights
),
middle AS (SELECT idx, list_transform(w2, lambda a: list_dot_product(h, a)) AS x FROM hidden),
embedded AS {_spread('middle')}"""


def _pair_scores(weights: str) -> str:
    """Scores of table ``pairs`` (p, c) with the vectors ``xp`` and ``xc``, layer by layer."""
    return f"""
{weights},
layer1 AS (
  SELECT p, c, w2, b1, b2, list_transform(w1, lambda a: list_dot_product(xp, a)) AS sp,
         list_transform(w1, lambda a: list_dot_product(xc, a)) AS sc FROM pairs, weights
),
hidden AS (
  SELECT p, c, w2, b2, list_transform(range(1, 33), lambda k: greatest(sp[k] + b1[k], 0)) AS hp,
    list_transform(range(1, 33), lambda k: greatest(sc[k] / 2 + sp[k] / sqrt(2) + b1[k], 0)) AS hc FROM layer1
),
layer2 AS (
  SELECT p, c, b2, list_transform(w2, lambda a: list_dot_product(hp, a)) AS zp,
         list_transform(w2, lambda a: list_dot_product(hc, a)) AS yc FROM hidden
),
pair_scores AS (
  SELECT p, c, 1 / (1 + exp(list_sum(list_transform(range(1, 17), lambda k:
    (zp[k] + b2[k]) * (yc[k] / 2 + zp[k] / sqrt(2) + b2[k]))))) AS base_score FROM layer2
)"""


def _log_scores(weights: str) -> str:
    return f"""WITH RECURSIVE {_SCORED},
texts AS (
  SELECT pos, risky, coalesce(parent_process_id, 'unknown_parent') AS parent_text,
    coalesce(process_name, 'unknown') || '_' || coalesce(args, '') || '_' || user_id AS child_text
  FROM scored
),
parent_seeds AS (SELECT parent_text, {_seed('parent_text')} AS p FROM (SELECT DISTINCT parent_text FROM texts)),
child_seeds AS (SELECT child_text, {_seed('child_text')} AS c FROM (SELECT DISTINCT child_text FROM texts)),
seeds AS (SELECT p AS seed FROM parent_seeds UNION SELECT c FROM child_seeds), {_DRAWS},
seeded AS (
  SELECT pos, risky, p, c FROM texts JOIN parent_seeds USING (parent_text) JOIN child_seeds USING (child_text)
),
pairs AS (
  SELECT p, c, a.x AS xp, b.x AS xc FROM (SELECT DISTINCT p, c FROM seeded)
  JOIN vectors a ON a.seed = p JOIN vectors b ON b.seed = c
), {_pair_scores(weights)}
SELECT pos, round(base_score, 6) AS base_score,
  round(least(0.99, base_score + CASE WHEN risky THEN 0.90 ELSE 0.0 END), 6) AS score
FROM seeded JOIN pair_scores USING (p, c)"""


_VECTORS = """
n AS (SELECT count(*) AS n FROM embeddings),
strided AS (SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst FROM embeddings, n)"""

_DOT = """list_sum(list_transform(range(1, 65), lambda i:
  CAST(s.embedding[i] AS DOUBLE) * CAST(t.embedding[i] AS DOUBLE)))"""

def _lines(*parts: str) -> str:
    """SQL texts with a line feed between them."""
    return " || chr(10) || ".join(parts)


_CHAT_ANALYSIS = _lines(
    """'<provenance process="' || id || '">'""", "context", "'</provenance>'", "'What happened, and by which technique?'")

_REPORT = """
'--- 1. GRAPH CONTEXT ---' || chr(10) || {context} || chr(10) || chr(10)
|| '--- 2. THREAT ANALYSIS ---' || chr(10) || {analysis} || chr(10) || chr(10)
|| '--- 3. STRATEGY ---' || chr(10) || {strategy} || chr(10) || chr(10)
|| '--- 4. VERIFIED COMMANDS (Audited) ---' || chr(10) || {commands}"""

# The stand-in model answers with digests of its system and user texts, so each stage's answer
# hangs on all before. System texts are wording, not results: they are taken as they stand.
def _answer(template: prompts.Template, user: str) -> str:
    system = hashlib.md5(template.system.encode()).hexdigest()[:8]
    return _lines("'```bash'", f"'{system} ' || md5({user}) || ' '", "'```'") + " || chr(10)"


def _unfenced(answer: str) -> str:
    return f"trim(replace(replace({answer}, '```bash', ''), '```', ''), ' ' || chr(10))"


# (process, context) rows of a query to its reports, stage by stage
_STAGES = f"""
stage1 AS (SELECT *, {_answer(prompts.ANALYSIS, _CHAT_ANALYSIS)} AS analysis FROM short),
stage2 AS (SELECT *, {_answer(prompts.STRATEGY, _lines("'<analysis>'", 'analysis', "'</analysis>'",
    "'Which three steps contain this?'"))} AS strategy FROM stage1),
stage3 AS (SELECT *, {_unfenced(_answer(prompts.COMMANDS, _lines("""'<steps process="' || id || '">'""", 'strategy', "'</steps>'",
    "'Which commands carry them out?'")))} AS draft FROM stage2),
stage4 AS (SELECT *, {_unfenced(_answer(prompts.AUDIT, _lines("'<analysis>'", 'analysis', "'</analysis>'", "'<commands>'", 'draft',
    "'</commands>'", "'Which of them may run?'")))} AS commands FROM stage3),
reported AS (SELECT id, {_REPORT.format(context='context', analysis="trim(analysis, ' ' || chr(10))",
    strategy="trim(strategy, ' ' || chr(10))", commands='commands')} AS report FROM stage4)"""

ORACLES: dict[str, str] = {
    # graph
    "process_nodes": f"WITH {_GRAPH} SELECT id, cmd_line FROM nodes",
    "process_nodes_first": f"""WITH {_LOGS},
named_rows AS (
  SELECT process_id AS id, pos, 0 AS role, coalesce(args, process_name) AS cmd_line, user_id, is_evil FROM named
  UNION ALL
  SELECT parent_process_id, pos, 1, NULL, NULL, NULL FROM named WHERE parent_process_id IS NOT NULL
)
SELECT id, cmd_line, user_id, is_evil FROM named_rows
QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, role) = 1""",
    "spawn_edges": f"WITH {_GRAPH} SELECT src, dst FROM edges",
    "typed_edges": f"""WITH {_LOGS}
SELECT DISTINCT * FROM (
  SELECT 'SPAWNED' AS rel, parent_process_id AS src, process_id AS dst,
         CAST(NULL AS VARCHAR) AS port, timestamp_ns AS timestamp, event_type AS type
  FROM named WHERE parent_process_id IS NOT NULL
  UNION ALL
  SELECT 'ACCESSED', process_id, file_path, NULL, timestamp_ns, event_type
  FROM named WHERE file_path IS NOT NULL AND event_type IN ('EVENT_OPEN', 'EVENT_WRITE')
  UNION ALL
  SELECT 'CONNECTED_TO', process_id, coalesce(remote_ip, 'LOCAL_SOCKET'),
         coalesce(remote_port, 'ANY'), timestamp_ns, event_type
  FROM named WHERE remote_ip IS NOT NULL OR event_type = 'EVENT_CONNECT'
)""",
    "file_nodes": f"""WITH {_LOGS} SELECT DISTINCT file_path AS path FROM named
WHERE file_path IS NOT NULL AND event_type IN ('EVENT_OPEN', 'EVENT_WRITE')""",
    "network_nodes": f"""WITH {_LOGS}
SELECT DISTINCT coalesce(remote_ip, 'LOCAL_SOCKET') AS ip, coalesce(remote_port, 'ANY') AS port
FROM named WHERE remote_ip IS NOT NULL OR event_type = 'EVENT_CONNECT'""",
    "graph_counts": f"""WITH {_GRAPH}
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges""",
    "known_edges": f"""WITH {_GRAPH} SELECT src, dst FROM edges
WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)""",
    "resolved_ids": f"WITH {_LOGS} SELECT pos, process_id AS id, parent AS parent_id, cmd FROM named",
    "graph_upsert": f"WITH {_GRAPH} SELECT id, cmd_line FROM nodes",
    # ancestry and artifacts
    "ancestry_context": f"WITH {_ANCESTRY} SELECT id, context FROM short",
    "touched_artifacts": f"""WITH {_LOGS} {_TOUCHED}
SELECT id, coalesce(array_to_string(files, ','), '') AS files,
  coalesce(array_to_string(ips, ','), '') AS ips, file_count, ip_count FROM artifacts""",
    "artifact_context": f"WITH {_ANCESTRY} {_TOUCHED} {_LONG} SELECT id, context FROM long",
    "alert_context": f"""WITH {_SCORED}, {_ANCESTRY.replace(_LOGS + ',', '', 1)},
asked AS (
  SELECT pos, CASE WHEN pos % 97 = 0 THEN 'x' || process_id ELSE process_id END AS process_id FROM alerted
)
SELECT pos, process_id, coalesce(context, 'No extended context found.') AS context
FROM asked LEFT JOIN short ON id = process_id""",
    # ingest
    "event_filter": f"WITH {_NESTED} SELECT pos, event_type FROM kept",
    "flatten_event": f"WITH {_NESTED} SELECT * FROM flat",
    "labelled_logs": f"WITH {_LOGS} {_LABELLED.format(keys='pos,')}",
    "split_counts": f"""WITH {_LOGS}
SELECT {_SPLIT}, 'host.bin.' || CAST(pos % 41 AS VARCHAR) || '.gz' AS src_file, count(*) AS n_logs
FROM named GROUP BY ALL""",
    "rejected_lines": f"""WITH {_LOGS}
SELECT timestamp_ns, CAST(pos % 17 = 0 AS INTEGER) AS rejected FROM named""",
    "file_errors": f"""WITH {_LOGS}
SELECT CAST(pos % 13 AS INTEGER) AS file, count(*) - CAST(pos % 13 IN (3, 7) AS INTEGER) AS n_logs,
  CAST(pos % 13 IN (3, 7) AS INTEGER) AS n_errors FROM named GROUP BY pos % 13""",
    "json_lines_logs": f"""WITH {_LOGS}
SELECT timestamp_ns, event_type, process_id, parent_process_id, cmd AS cmd_line, user_id,
  file_path, remote_ip, remote_port, is_suspicious, is_evil FROM named""",
    "csv_logs": f"WITH {_LOGS} {_LABELLED.format(keys='')}",
    "csv_mixed_headers_logs": f"""WITH {_LOGS}
SELECT * EXCLUDE (pos, user_id), CASE WHEN pos % 3 = 2 THEN NULL ELSE user_id END AS user_id
FROM ({_LABELLED.format(keys='pos,').replace("FROM named", "FROM (SELECT * FROM named)")})""",
    "archive_logs": f"WITH {_NESTED} SELECT * EXCLUDE (pos), {_SPLIT} FROM flat",
    # features and model
    "text_seeds": f"SELECT doc_id, {_seed('text')} AS seed FROM documents",
    "log_seeds": f"""WITH {_LOGS},
texts AS (
  SELECT pos, coalesce(parent_process_id, 'unknown_parent') AS parent_text,
    coalesce(process_name, 'unknown') || '_' || coalesce(args, '') || '_' || user_id AS child_text
  FROM named
)
SELECT pos, {_seed('parent_text')} AS parent_seed, {_seed('child_text')} AS child_seed FROM texts""",
    "node_index": f"WITH {_INDEX} SELECT id, idx, {_seed('cmd_line')} AS seed FROM idx",
    "edge_index": f"WITH {_INDEX} SELECT src, dst FROM pairs",
    "grown_node_index": f"WITH {_NUMBERED} SELECT id, idx, {_seed('cmd_line')} AS seed FROM numbered",
    "grown_edge_index": f"""WITH {_NUMBERED}
SELECT s.idx AS src, d.idx AS dst FROM edges e JOIN numbered s ON s.id = e.src JOIN numbered d ON d.id = e.dst""",
    "run_figures": _figures("timestamp_ns % 17 = 0", errors=False),
    "file_run_figures": _figures("pos % 13 IN (3, 7) AND pos = max(pos) OVER (PARTITION BY pos % 13)", errors=True),
    "in_degree": f"WITH {_INDEX} SELECT idx, degree FROM degree",
    "edge_weights": f"""WITH {_INDEX}
SELECT src, dst, round(1.0 / sqrt(CAST(s.degree * d.degree AS DOUBLE)), 6) AS weight
FROM looped JOIN degree s ON s.idx = src JOIN degree d ON d.idx = dst""",
    "propagate": f"""WITH {_INDEX}
SELECT i.id, round(sum(coalesce(length(j.cmd_line), 0) / sqrt(CAST(s.degree * d.degree AS DOUBLE))), 6) AS h
FROM looped l JOIN degree s ON s.idx = l.src JOIN degree d ON d.idx = l.dst
JOIN idx i ON i.idx = l.dst JOIN idx j ON j.idx = l.src GROUP BY i.id""",
    "edge_scores": f"""WITH {_VECTORS}
SELECT src, dst, round(score, 6) AS score, round(1 - 1 / (1 + exp(-score)), 6) AS anomaly FROM (
  SELECT src, dst, {_DOT} AS score
  FROM strided JOIN embeddings s ON s.vec_id = src JOIN embeddings t ON t.vec_id = dst
)""",
    "edge_loss": f"""WITH {_VECTORS},
labelled AS (
  SELECT src, dst, 1.0 AS y FROM strided
  UNION ALL SELECT dst, (src * 3 + 2) % 5, 0.0 FROM strided
),
losses AS (
  SELECT y, greatest(score, 0.0) + ln(1 + exp(-abs(score))) - y * score AS loss FROM (
    SELECT y, {_DOT} AS score
    FROM labelled JOIN embeddings s ON s.vec_id = src JOIN embeddings t ON t.vec_id = dst
  )
),
means AS (
  SELECT avg(loss) FILTER (y = 1.0) AS edge_loss, avg(loss) FILTER (y = 0.0) AS non_edge_loss FROM losses
)
SELECT round(edge_loss, 6) AS edge_loss, round(non_edge_loss, 6) AS non_edge_loss,
  round(edge_loss + non_edge_loss, 6) AS loss FROM means""",
    "negative_edges": f"WITH {_INDEX}, {_negatives('0:1')} SELECT src, dst FROM non_edges",
    "first_epoch_loss": f"""WITH RECURSIVE {_INDEX}, {_embeddings()}, {_fit(1)}
SELECT 1 AS epoch, round(loss, 6) AS loss FROM loss1""",
    "fit_losses": f"""WITH RECURSIVE {_INDEX}, {_embeddings()}, {_fit(3)}
SELECT epoch, round(loss, 6) AS loss FROM (
  SELECT 1 AS epoch, loss FROM loss1 UNION ALL SELECT 2, loss FROM loss2 UNION ALL SELECT 3, loss FROM loss3)""",
    "dense_negative_edges": f"WITH {_DENSE} SELECT src, dst FROM free",
    "dense_negative_sample": f"WITH {_DENSE}, {_ranks('total // 3')} SELECT src, dst FROM free JOIN ranks USING (rank)",
    "dense_negative_rest": f"WITH {_DENSE}, {_ranks('total - total * 3 // 4')} SELECT src, dst FROM free ANTI JOIN ranks USING (rank)",
    "node_features": f"""WITH RECURSIVE {_INDEX},
seeded AS (SELECT idx, {_seed('cmd_line')} AS seed FROM idx),
seeds AS (SELECT DISTINCT seed FROM seeded), {_DRAWS}
SELECT idx, {', '.join(f'CAST(x[{i + 1}] AS FLOAT) AS x{i}' for i in range(16))}
FROM seeded JOIN vectors USING (seed)""",
    "log_scores": _log_scores(_weights()),
    "fitted_weight_scores": _log_scores(_fitted_weights(3)),
    "node_embeddings": f"""WITH RECURSIVE {_INDEX}, {_embeddings()}
SELECT idx, {', '.join(f'round(x[{i + 1}], 6) AS z{i}' for i in range(16))} FROM embedded""",
    "edge_anomalies": f"""WITH RECURSIVE {_INDEX}, {_embeddings()}
SELECT src, dst, round(1 - 1 / (1 + exp(-list_dot_product(s.x, d.x))), 6) AS anomaly
FROM pairs JOIN embedded s ON s.idx = src JOIN embedded d ON d.idx = dst""",
    # alerts
    "boosted_scores": f"WITH {_SCORED} SELECT pos, risky, round(score, 6) AS score FROM scored",
    "boosted_scores_whole_words": f"""WITH {_SCORED}
SELECT pos, round(least(0.99, base + CASE WHEN regexp_matches(hay,
  '(^|\\W)(tsm|sshd|wget|curl|chmod|nc|bash -i)($|\\W)') THEN 0.90 ELSE 0.0 END), 6) AS score FROM scored""",
    "alerts": f"WITH {_SCORED} SELECT {_LINES} FROM alerted",
    "first_logs": f"WITH {_SCORED} SELECT {_LINES} FROM scored ORDER BY pos LIMIT 2000",
    "triage_metrics": f"""WITH {_SCORED},
graded AS (
  SELECT CASE WHEN score > 0.85 AND is_evil = 1 THEN 'TP' WHEN score > 0.85 THEN 'FP'
    WHEN is_evil = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scored
),
{_counts('graded')} SELECT tp, fp, tn, fn, n, {_metric_columns('1')} FROM metrics""",
    # evaluation
    "verdicts": f"""WITH {_ANSWERS} SELECT doc_id, model, predicted, outcome,
  CASE WHEN is_evil = 1 THEN 'Malicious' ELSE 'Benign' END AS label FROM graded""",
    "text_verdicts": """
SELECT doc_id, contains(low, 'malicious') AND NOT contains(low, 'benign') AS predicted FROM (
  SELECT doc_id, lower(text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'Verdict: Malicious'
    WHEN 1 THEN chr(10) || 'malicious? BENIGN' ELSE '' END) AS low FROM documents
)""",
    "confusion": f"WITH {_ANSWERS}, {_counts('graded', 'model')} SELECT * FROM counts",
    "overall_metrics": f"""WITH {_ANSWERS}, {_counts('graded')}
SELECT tp, fp, tn, fn, n, {_metric_columns('1')} FROM metrics""",
    "metrics_by_model": f"""WITH {_ANSWERS}, {_counts('graded', 'model')}
SELECT model, tp, fp, tn, fn, n, {_metric_columns('100')} FROM metrics""",
    "benchmark_matrix": f"""WITH {_ANSWERS},
{_counts('graded', 'model', ', sum(length(text) / 8.0) AS seconds')}
SELECT model, printf('%.2f', a * 100) AS accuracy, printf('%.2f', p * 100) AS precision,
  printf('%.2f', r * 100) AS recall, printf('%.2f', f * 100) AS f1,
  CAST(round(seconds, 2) AS VARCHAR) AS seconds FROM metrics""",
    "class_counts": f"""WITH {_LOGS}
SELECT CASE WHEN is_evil = 1 THEN 'Malicious' ELSE 'Benign' END AS class, count(*) AS n_logs
FROM named GROUP BY 1""",
    "balanced_sample": f"""WITH {_LOGS} SELECT pos, is_evil FROM named
QUALIFY row_number() OVER (PARTITION BY is_evil ORDER BY sha256('7:' || CAST(pos AS VARCHAR)), pos) <= 20""",
    "large_balanced_sample": f"""WITH {_LOGS} SELECT pos, is_evil FROM named
QUALIFY row_number() OVER (PARTITION BY is_evil ORDER BY sha256('7:' || CAST(pos AS VARCHAR)), pos) <= 2000""",
    "shuffled_sample": f"""WITH {_LOGS},
picked AS (
  SELECT pos, is_evil FROM named
  QUALIFY row_number() OVER (PARTITION BY is_evil ORDER BY sha256('7:' || CAST(pos AS VARCHAR)), pos) <= 20
)
SELECT pos, is_evil, row_number() OVER (ORDER BY sha256('1:' || CAST(pos AS VARCHAR))) - 1 AS place FROM picked""",
    "model_pairs": f"""WITH {_LOGS} SELECT pos, model FROM (
  SELECT pos FROM named
  QUALIFY row_number() OVER (PARTITION BY is_evil ORDER BY sha256('7:' || CAST(pos AS VARCHAR)), pos) <= 20
) CROSS JOIN (
  SELECT unnest(['phi4-mini', 'qwen2.5-coder:7b', 'llama3.1:8b', 'deepseek-r1:14b', 'codestral', 'qwen3:32b']) AS model
)""",
    # prompts, reports, model chains
    "raw_log_text": f"""WITH {_LOGS}
SELECT pos, '{{' || chr(10) || concat_ws(',' || chr(10),
  '  "process_id" : "' || process_id || '"',
  '  "parent_process_id" : "' || parent_process_id || '"',
  '  "args" : "' || args || '"',
  '  "is_evil" : ' || CAST(is_evil AS VARCHAR)) || chr(10) || '}}' AS log FROM named""",
    "analysis_prompts": f"""WITH {_ANCESTRY} SELECT id,
  'You are a terse security analyst. Answer in two sentences: first the root cause, then the MITRE ATT&CK tactic and technique.' AS system_text,
  {_CHAT_ANALYSIS} AS user_text FROM short""",
    "stripped_answers": """SELECT conv_id, turn,
  regexp_replace(replace(replace('```bash' || chr(10) || '  ' || text || chr(10) || '```' || chr(10) || chr(9),
    '```bash', ''), '```', ''), '^\\s+|\\s+$', '', 'g') AS text FROM conversations""",
    "command_audit": f"""WITH {_LOGS}
SELECT pos, CASE pos % 7 WHEN 0 THEN 'root_delete' WHEN 1 THEN 'shutdown' WHEN 2 THEN 'database_wipe'
  WHEN 3 THEN CASE WHEN process_id <> '1' THEN 'kill_other' ELSE '' END
  WHEN 4 THEN 'kill_by_name' ELSE '' END AS unsafe FROM named""",
    "report_texts": "WITH " + _ANCESTRY + " SELECT id, " + _REPORT.format(
        context="context",
        analysis="'Process ' || id || ' was started oddly.'",
        strategy="'- isolate' || chr(10) || '- stop' || chr(10) || '- review'",
        commands="'kill -STOP ' || id",
    ) + " AS report FROM short",
    "model_verdicts": f"""WITH {_ANCESTRY}
SELECT id, CASE WHEN contains(context, 'wget') OR contains(context, 'curl')
    THEN 'Malicious: T1105.' ELSE 'Benign.' END AS analysis,
  CAST(NULL AS VARCHAR) AS error,
  contains(context, 'wget') OR contains(context, 'curl') AS predicted FROM short""",
    "model_reports": f"""WITH {_ANCESTRY}, {_STAGES}
SELECT id AS process_id, report, CAST(NULL AS VARCHAR) AS error FROM reported""",
    "triaged_alerts": f"""WITH {_SCORED}, {_ANCESTRY.replace(_LOGS + ',', '', 1)}, {_STAGES}
SELECT pos, process_id, printf('%.2f', score) AS score_text, report
FROM alerted JOIN reported ON id = process_id""",
    "model_comparison": f"""WITH {_ANCESTRY} {_TOUCHED} {_LONG},
picked AS (
  SELECT * FROM named
  QUALIFY row_number() OVER (PARTITION BY is_evil ORDER BY sha256('7:' || CAST(pos AS VARCHAR)), pos) <= 200
),
texts AS (
  SELECT is_evil, context, concat_ws(' ', args, process_name) || chr(10) || context AS shown
  FROM picked JOIN long ON long.id = process_id
),
graded AS (
  SELECT 'rule' AS model, CASE WHEN contains(shown, 'wget') OR contains(shown, 'curl')
    THEN CASE WHEN is_evil = 1 THEN 'TP' ELSE 'FP' END
    ELSE CASE WHEN is_evil = 1 THEN 'FN' ELSE 'TN' END END AS outcome FROM texts
  UNION ALL
  SELECT 'digest', CASE WHEN is_evil = 1 THEN 'FN' ELSE 'TN' END FROM texts
),
{_counts('graded', 'model')}
SELECT model, tp, fp, tn, fn, n, {_metric_columns('100')} FROM metrics""",
    # streaming
    "stream_alerts": f"WITH {_SCORED} SELECT pos, process_id, round(score, 6) AS score FROM alerted",
    "stream_confusion": f"""WITH {_SCORED},
graded AS (
  SELECT CASE WHEN score > 0.85 AND is_evil = 1 THEN 'TP' WHEN score > 0.85 THEN 'FP'
    WHEN is_evil = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scored
),
{_counts('graded')} SELECT * FROM counts""",
    "stream_graph": f"WITH {_GRAPH} SELECT id, cmd_line FROM nodes",
    "stream_triage": f"""WITH {_SCORED}, {_ANCESTRY.replace(_LOGS + ',', '', 1)}, {_STAGES}
SELECT pos, process_id, report FROM alerted JOIN reported ON id = process_id""",
}

for _name in ("json_objects_logs", "json_files_logs", "json_array_logs", "python_literal_logs"):
    ORACLES[_name] = f"""WITH {_LOGS}
SELECT timestamp_ns, event_type, process_id, parent_process_id, process_name, args, user_id,
  file_path, remote_ip, remote_port, is_suspicious, is_evil FROM named"""
ORACLES["broken_tail_logs"] = ORACLES["json_array_logs"] + """
WHERE pos % 13 NOT IN (3, 7) OR pos NOT IN (SELECT max(pos) FROM named GROUP BY pos % 13)"""
for _name, _plain in (
    ("stored_typed_edges", "typed_edges"), ("typed_edges_upsert", "typed_edges"),
    ("stored_weight_scores", "log_scores"), ("stored_file_nodes", "file_nodes"), ("stored_network_nodes", "network_nodes"),
):
    ORACLES[_name] = ORACLES[_plain]
# streamed logs carry their position as time
ORACLES["stream_typed_edges"] = ORACLES["typed_edges"].replace(
    "timestamp_ns AS timestamp", "pos AS timestamp").replace("timestamp_ns, event_type", "pos, event_type")
