"""Training-data operators: tokenising, decontamination, deduplication, quality and scans."""
