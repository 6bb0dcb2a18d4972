"""The corpus pipeline over `documents`: each stage's result is written as Parquet and read again as the next one's input.

The stages are defined in acctlens.llm.pipeline.
"""

from acctlens.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
