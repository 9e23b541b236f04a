"""Part of phytomill: sources."""
