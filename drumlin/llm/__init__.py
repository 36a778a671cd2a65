"""Training-data operators: mixing, secrets, sharding, chat rendering, quality,
near-duplicates, decontamination, WARC archives, line dedup and page extraction.

Nothing outside this subpackage imports it."""
