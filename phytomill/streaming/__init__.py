"""Part of phytomill: streaming."""
