"""Training-data operators: URL filters, fingerprints, deduplication, scans, packing and classifiers."""
