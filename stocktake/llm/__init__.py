"""Operators for preparing training text at corpus scale.

Nothing else in ``stocktake`` imports this subpackage; its queries are listed in
``stocktake.llm.queries`` and join the driver's registry only when it can be imported.
"""
