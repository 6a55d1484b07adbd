"""The corpus pipeline: STAGES, ORACLE_SQL and run() (counted as part of packetloom.llm)."""

from packetloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
