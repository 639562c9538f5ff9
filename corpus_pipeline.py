"""From raw documents to packed training sequences, stage by stage: ``stocktake.llm.pipeline`` for whoever runs it from here."""

from stocktake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
