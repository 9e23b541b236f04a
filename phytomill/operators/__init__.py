"""Part of phytomill: operators."""
