"""Training-data operators: token store, quality, packing, mixing, fingerprints, dedup, HTML, WARC, chat."""
