"""The detection queries on packet streams.

The first four and the zip difference are the batch pipelines over windows; the
queries with registers keep state per epoch and key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.operators.basic import filter_cmp
from packetloom.operators.folds import GroupedClose, GroupedFold
from packetloom.plans import detections
from packetloom.schema import CONSTANTS, EPOCH, ORDER
from packetloom.streaming.state import stateful_fold_stream
from packetloom.streaming.windows import WINDOW, numbered_epoch, window_epoch, with_window

_LONG = T.LongType()
_SYN_ACK = CONSTANTS["TCP_FLAG_SYN_ACK"]

# Registers of one server: sequence number it expects next, half-open handshakes.
HANDSHAKE_STATE = T.StructType([T.StructField("nextseq", _LONG), T.StructField("cnt", _LONG)])
HANDSHAKE_OUT = T.StructType(
    [T.StructField(n, _LONG) for n in (EPOCH, ORDER, "nkey", "nextseq", "cnt")]
)

# Registers of one flow: largest sequence number, packets that did not exceed it.
FLOW_STATE = T.StructType([T.StructField("largest", _LONG), T.StructField("late", _LONG)])
FLOW_OUT = T.StructType(
    [T.StructField(EPOCH, _LONG), *[T.StructField(k, _LONG) for k in detections.FLOW], T.StructField("count", _LONG)]
)


def _sizes(packets: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(first, len(packets)))


def _handshakes(key: tuple, packets: pd.DataFrame, before: tuple) -> tuple[pd.DataFrame, tuple]:
    """Half-open handshakes of a server after each of its packets."""
    nextseq, cnt = before
    syn_ack = packets["tcp_flags"] == _SYN_ACK
    expected = ((packets["tcp_seq"] + 1) % (1 << 32)).where(syn_ack).ffill().fillna(nextseq).astype("int64")
    step = syn_ack.astype("int64").where(expected != packets["tcp_ack"], -1)
    counts = step.cumsum() + cnt
    out = packets[[EPOCH, ORDER, "nkey"]].assign(nextseq=expected, cnt=counts)
    return out, (int(expected.iloc[-1]), int(counts.iloc[-1]))


def _handshakes_of_many(packets: pd.DataFrame, first: np.ndarray, before: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
    nextseq, cnt = before
    sizes = _sizes(packets, first)
    own, last = np.repeat(np.arange(len(first)), sizes), first + sizes - 1
    flags, seq, ack = (packets[c].to_numpy("int64") for c in ("tcp_flags", "tcp_seq", "tcp_ack"))
    syn_ack = flags == _SYN_ACK
    latest = np.maximum.accumulate(np.where(syn_ack, np.arange(len(own)), -1))
    expected = np.where(latest >= first[own], (seq[latest] + 1) % (1 << 32), nextseq[own])
    step = np.where(expected != ack, syn_ack.astype("int64"), -1)
    total = np.cumsum(step)
    counts = total + (cnt - total[first] + step[first])[own]
    out = packets[[EPOCH, ORDER, "nkey"]].assign(nextseq=expected, cnt=counts)
    return out, [expected[last], counts[last]]


handshake_fold = GroupedFold(_handshakes, _handshakes_of_many)


def _largest_seq(key: tuple, packets: pd.DataFrame, before: tuple) -> tuple[pd.DataFrame, tuple]:
    """Packets of a flow that do not exceed its largest sequence number."""
    largest, late = before
    seq = packets["tcp_seq"]
    seen = seq.cummax().clip(lower=largest).shift(1, fill_value=largest)
    return packets.iloc[:0], (int(max(largest, seq.max())), late + int((seq <= seen).sum()))


def _largest_seq_of_many(packets: pd.DataFrame, first: np.ndarray, before: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
    largest, late = before
    sizes = _sizes(packets, first)
    own, last = np.repeat(np.arange(len(first)), sizes), first + sizes - 1
    seq = packets["tcp_seq"].to_numpy("int64")
    greatest = np.maximum(packets["tcp_seq"].astype("int64").groupby(own).cummax().to_numpy(), largest[own])
    seen = np.concatenate(([0], greatest[:-1]))
    seen[first] = largest
    return packets.iloc[:0], [greatest[last], late + np.add.reduceat((seq <= seen).astype("int64"), first)]


flow_fold = GroupedFold(_largest_seq, _largest_seq_of_many)


def _late_packets(key: tuple, registers: tuple) -> pd.DataFrame:
    return pd.DataFrame([[*key, registers[1]]], columns=FLOW_OUT.names)


def _late_packets_of_many(keys: list[np.ndarray], registers: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(FLOW_OUT.names, [*keys, registers[1]], strict=True)))


flow_count = GroupedClose(_late_packets, _late_packets_of_many)


def windowed(detection, packets: DataFrame, n: int, interval: float, start_us: int, watermark: str) -> DataFrame:
    """A batch detection over windows, with epoch numbers in the result."""
    found = detection(with_window(packets, interval, watermark, start_us), n, by=WINDOW)
    keys = [c for c in found.columns if c != WINDOW]
    return found.select(window_epoch(interval, start_us), *keys)


def newconn(packets, n=50, interval=0.5, start_us=0, *, watermark):
    return windowed(detections.newconn, packets, n, interval, start_us, watermark)


def ddos(packets, n=180, interval=0.5, start_us=0, *, watermark):
    return windowed(detections.ddos, packets, n, interval, start_us, watermark)


def portscan(packets, n=35, interval=0.5, start_us=0, *, watermark):
    return windowed(detections.portscan, packets, n, interval, start_us, watermark)


def superspreader(packets, n=200, interval=0.5, start_us=0, *, watermark):
    return windowed(detections.superspreader, packets, n, interval, start_us, watermark)


def incomplete_flows(packets, n=1, interval=0.5, start_us=0, *, watermark):
    return windowed(detections.incomplete_flows, packets, n, interval, start_us, watermark)


def synflood_counts(
    packets: DataFrame, interval: float = 0.5, start_us: int = 0, *, watermark: str
) -> DataFrame:
    """Half-open handshakes after each packet, as the packets come in."""
    hs = detections.handshake_packets(numbered_epoch(packets, interval, watermark, start_us), EPOCH, ORDER, ["ts"])
    return stateful_fold_stream(
        hs, ["nkey"], handshake_fold, (0, 0), HANDSHAKE_STATE, HANDSHAKE_OUT, interval, start_us
    )


def synflood_alerts(
    packets: DataFrame, n: int = 12, interval: float = 0.5, start_us: int = 0, *, watermark: str
) -> DataFrame:
    """Each packet after which its server has over ``n`` half-open handshakes."""
    return synflood_counts(packets, interval, start_us, watermark=watermark).where(F.col("cnt") > n)


ALERT_STATE = T.StructType([T.StructField("seen", _LONG)])


def alert_packets(
    packets: DataFrame,
    keys: list[str],
    n: int,
    interval: float = 0.5,
    start_us: int = 0,
    *,
    watermark: str,
) -> DataFrame:
    """The whole packets that bring the count of their key in the epoch to ``n``."""
    numbered = numbered_epoch(packets, interval, watermark, start_us)

    def nth(key: tuple, rows: pd.DataFrame, before: tuple) -> tuple[pd.DataFrame, tuple]:
        seen = before[0]
        at = n - seen - 1
        return rows.iloc[at : at + 1] if at >= 0 else rows.iloc[:0], (seen + len(rows),)

    def nth_of_many(rows: pd.DataFrame, first: np.ndarray, before: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        seen, sizes = before[0], _sizes(rows, first)
        at = n - seen - 1
        return rows.iloc[(first + at)[(at >= 0) & (at < sizes)]], [seen + sizes]

    fold = GroupedFold(nth, nth_of_many)
    return stateful_fold_stream(numbered, keys, fold, (0,), ALERT_STATE, numbered.schema, interval, start_us)


def tcp_nonmonotonic(
    packets: DataFrame, interval: float = 0.5, start_us: int = 0, *, watermark: str
) -> DataFrame:
    """Per TCP flow and closed epoch, the packets with a non-increasing sequence number."""
    tcp = filter_cmp(packets, "ipv4.protocol", "eq", "IP_PROTOCOLS_TCP")
    flows = numbered_epoch(tcp, interval, watermark, start_us).select(
        EPOCH, "ts", ORDER, *[F.col(k).cast("long").alias(k) for k in detections.FLOW], "tcp_seq"
    )
    return stateful_fold_stream(
        flows, detections.FLOW, flow_fold, (0, 0), FLOW_STATE, FLOW_OUT, interval, start_us, flow_count
    )
