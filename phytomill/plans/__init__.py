"""Part of phytomill: plans."""
