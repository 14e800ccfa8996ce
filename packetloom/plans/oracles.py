"""The same questions in ANSI SQL, for checking every query on the test tables."""

from __future__ import annotations

from packetloom.functions.hashing import PRIME, row_pair
from packetloom.operators.sketch import cells_per_row

PACKETS = """
packets AS (
  SELECT event_id AS pkt_no,
         epoch_us(ts) AS us,
         (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400000000 AS epoch,
         user_id AS src_addr,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS dst_addr,
         user_id % 1024 AS sport,
         CAST(floor(value) AS BIGINT) % 1024 AS dport,
         CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto,
         40 + event_id % 1000 AS size,
         CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 18
              WHEN 'view' THEN 16 WHEN 'purchase' THEN 17 ELSE 0 END AS tcp_flags,
         event_id % 7 AS tcp_seq,
         (event_id * 3) % 7 AS tcp_ack,
         CASE WHEN event_type = 'error' THEN 0 ELSE 20 END AS tcp_hdr_size
  FROM events)"""

FLOWS = """
flows AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS epoch, l_suppkey AS src_addr, l_partkey AS dst_addr,
         CAST(l_quantity AS BIGINT) AS size, l_returnflag AS flag
  FROM lineitem)"""

HANDSHAKE = """
hs AS (
  SELECT epoch, pkt_no, tcp_seq, tcp_ack, tcp_flags,
         CASE WHEN tcp_flags = 18 THEN src_addr ELSE dst_addr END AS nkey,
         CASE WHEN tcp_flags = 18 THEN 1 ELSE 0 END AS cnt_flag
  FROM packets WHERE proto = 6 AND (tcp_flags & 16) <> 0)"""

RUNNING = "ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

# Register steps of the SYN-flood query, for any grouping of its packets.
DELTA = "CASE cnt_flag WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END"


def with_packets(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([PACKETS, *ctes]) + "\n" + body


def cells(src: str, keys: list[str], d: int, width: int) -> str:
    """Rows of ``src`` times ``d`` sketch rows, with columns ``row`` and ``cell``."""
    rows = ", ".join(
        f"(CAST({i} AS BIGINT), CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(map(row_pair, range(d)))
    )
    q = f"(SELECT s.*, r.row, r.a AS _a, r.b AS _b, r.b AS _x FROM {src} s, (VALUES {rows}) r(row, a, b))"
    for k in keys:
        q = f"(SELECT * REPLACE (((_x + {k}) % {PRIME} * _a + _b) % {PRIME} AS _x) FROM {q})"
        q = f"(SELECT * REPLACE ((_x * _x + _a) % {PRIME} AS _x) FROM {q})"
    return f"(SELECT * EXCLUDE (_a, _b, _x), _x % {width} AS cell FROM {q})"


def bloom(src: str, keys: list[str], d: int, width: int) -> str:
    touched = cells(src, keys, d, width)
    return (
        f"(SELECT * FROM {src} WHERE pkt_no IN "
        f"(SELECT min(pkt_no) FROM {touched} GROUP BY epoch, row, cell))"
    )


def cm_running(src: str, keys: list[str], value: str, d: int, width: int) -> str:
    """``src`` with the running Count-Min estimate of each packet."""
    at = cells(src, keys, d, width)
    return (
        f"(SELECT s.*, e.estimate FROM {src} s JOIN (SELECT pkt_no, CAST(min(run) AS BIGINT) AS estimate FROM "
        f"(SELECT pkt_no, sum({value}) OVER (PARTITION BY epoch, row, cell {RUNNING}) AS run FROM {at}) "
        "GROUP BY pkt_no) e ON e.pkt_no = s.pkt_no)"
    )


def cm_final(src: str, keys: list[str], value: str, d: int, width: int) -> str:
    """Final Count-Min estimate of every (epoch, key) of ``src``."""
    ks = ", ".join(keys)
    at = cells(src, keys, d, width)
    return (
        f"(SELECT epoch, {ks}, CAST(min(total) AS BIGINT) AS estimate FROM "
        f"(SELECT epoch, {ks}, sum({value}) OVER (PARTITION BY epoch, row, cell) AS total FROM {at}) "
        f"GROUP BY epoch, {ks})"
    )


def sketch_report(key: str, distinct: list[str], n: int | str, sizes: list[tuple[int, int]], src: str = "packets") -> str:
    """(epoch, key) reported with a Bloom filter and a Count-Min of ``sizes`` (rows, cells)."""
    if distinct:
        src = bloom(src, distinct, *sizes[0])
    est = cm_running(f"(SELECT pkt_no, epoch, {key} FROM {src})", [key], "1", *sizes[-1])
    return f"(SELECT DISTINCT epoch, {key} FROM {est} WHERE estimate >= {n})"


def exact_report(key: str, elem: str, n: int) -> str:
    return (
        f"(SELECT epoch, {key} FROM packets GROUP BY epoch, {key} HAVING count(DISTINCT {elem}) >= {n})"
    )


def metrics(est: str, exact: str, key: str, n_epoch: str) -> str:
    """Per-epoch counts, precision and recall of two report sets."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    return f"""
  (SELECT epoch, n_est, n_exact, n_correct,
          CASE WHEN n_est > 0 THEN n_correct / n_est ELSE 1.0 END AS "precision",
          CASE WHEN n_exact > 0 THEN n_correct / n_exact ELSE 1.0 END AS recall
   FROM (
     SELECT r.epoch,
            CAST(coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_est,
            CAST(coalesce(sum(CASE WHEN x THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_exact,
            CAST(coalesce(sum(CASE WHEN e AND x THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_correct
     FROM (SELECT unnest(range({n_epoch})) AS epoch) r
     LEFT JOIN (
       SELECT coalesce(a.epoch, b.epoch) AS epoch, a.epoch IS NOT NULL AS e, b.epoch IS NOT NULL AS x
       FROM {est} a FULL JOIN {exact} b ON a.epoch = b.epoch AND {same}) m
     ON m.epoch = r.epoch GROUP BY r.epoch))"""


def rank(n_epoch: str, confidence: float) -> str:
    """1-based rank, from the best epoch down, that must still meet the bounds."""
    return f"(greatest(CAST(floor({n_epoch} * CAST({confidence} AS DOUBLE)) AS BIGINT) - 1, 0) + 1)"


def gate(metric_sql: str, rank: str, p_min: float, r_min: float, n_epoch: str) -> str:
    return f"""
  SELECT round(p, 6) AS "precision", round(r, 6) AS recall, round(avg_keys, 6) AS avg_keys,
         p >= {p_min} AND r >= {r_min} AS success
  FROM (SELECT max(CASE WHEN rp = {rank} THEN "precision" END) AS p,
               max(CASE WHEN rr = {rank} THEN recall END) AS r,
               sum(n_exact) / {n_epoch} AS avg_keys
        FROM (SELECT *, row_number() OVER (ORDER BY "precision" DESC) AS rp,
                     row_number() OVER (ORDER BY recall DESC) AS rr FROM {metric_sql}))"""


def widths(config, tables_bits: list[int], page_bytes: int) -> list[tuple[int, int]]:
    return [(d, cells_per_row(w, bits, page_bytes)) for (d, w), bits in zip(config, tables_bits)]


def value_report(keys: str, value: str, n: int, d: int, width: int, src: str = "packets") -> str:
    """(epoch, keys, value) of the keys whose Count-Min estimate reaches ``n``: the estimate at their last packet."""
    est = cm_running(f"(SELECT pkt_no, epoch, {keys}{'' if value == '1' else ', ' + value} FROM {src})", keys.split(", "), value, d, width)
    return f"(SELECT epoch, {keys}, max(estimate) AS value FROM {est} GROUP BY ALL HAVING max(estimate) >= {n})"


def relative_errors(est: str, exact: str, keys: str, n_epoch: str) -> str:
    """Mean relative error per epoch of valued reports."""
    same = " AND ".join(f"e.{k} = x.{k}" for k in ["epoch", *keys.split(", ")])
    return f"""
  (SELECT r.epoch, coalesce(are, 0) AS are FROM (SELECT unnest(range({n_epoch})) AS epoch) r LEFT JOIN (
     SELECT x.epoch, avg(CASE WHEN e.value IS NULL THEN 1.0 WHEN x.value = 0 THEN CASE WHEN e.value = 0 THEN 0.0 ELSE 1.0 END
       ELSE abs(e.value - x.value) / abs(x.value) END) AS are
     FROM {exact} x LEFT JOIN {est} e ON {same} GROUP BY x.epoch) a ON a.epoch = r.epoch)"""


def gate_are(metric_sql: str, are_sql: str, rank: str, p_min: float, r_min: float, are_max: float, n_epoch: str) -> str:
    return f"""
  SELECT g.* REPLACE (success AND a.are <= {are_max} AS success), round(a.are, 6) AS are
  FROM ({gate(metric_sql, rank, p_min, r_min, n_epoch)}) g,
       (SELECT max(CASE WHEN n = {rank} THEN are END) AS are FROM (SELECT are, row_number() OVER (ORDER BY are) AS n FROM {are_sql})) a"""
