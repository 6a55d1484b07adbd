"""Operators for preparing training text at scale; nothing else in packetloom imports this subpackage."""
