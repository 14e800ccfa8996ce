"""Packet-telemetry analytics as ordinary Spark DataFrame jobs."""

from packetloom.schema import CONSTANTS, FIELD_ALIASES, PACKET_SCHEMA

__all__ = ["CONSTANTS", "FIELD_ALIASES", "PACKET_SCHEMA"]
