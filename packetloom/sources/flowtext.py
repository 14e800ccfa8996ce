"""One flow per text line: ``10.0.0.1(1234) <-> 10.0.0.2(80) 6 60``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetloom.functions.scalar import ipv4_number, ipv4_text

# Fixed value: the shape of a flow line.
FLOW_LINE = r"^\s*(\d+\.\d+\.\d+\.\d+)\s*\((\d+)\)\s*<->\s*(\d+\.\d+\.\d+\.\d+)\s*\((\d+)\)\s*(\d+)\s+(-?\d+)"


def format_flow_text(df: DataFrame, out: str = "value") -> DataFrame:
    """One text line per packet, ready for ``write.text``."""
    line = F.format_string(
        "%s(%d) <-> %s(%d) %d %d", ipv4_text("src_addr"), "sport", ipv4_text("dst_addr"), "dport", "proto", "size"
    )
    return df.select(line.alias(out))


def parse_flow_text(df: DataFrame, value: str = "value") -> DataFrame:
    """Flow columns of text lines, and the line itself as ``raw`` where it has another shape.

    Every line gives a row; the flow columns of an odd one are null.
    """
    ok = F.col(value).rlike(FLOW_LINE)
    part = [F.when(ok, F.regexp_extract(value, FLOW_LINE, i)) for i in range(1, 7)]
    return df.select(
        ipv4_number(part[0]).alias("src_addr"),
        part[1].try_cast("int").alias("sport"),
        ipv4_number(part[2]).alias("dst_addr"),
        part[3].try_cast("int").alias("dport"),
        part[4].try_cast("int").alias("proto"),
        part[5].try_cast("int").alias("size"),
        F.when(~F.coalesce(ok, F.lit(False)), F.col(value)).alias("raw"),
    )
