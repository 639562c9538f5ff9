"""Part of stocktake; see the modules."""
