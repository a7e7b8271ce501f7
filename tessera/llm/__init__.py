"""Training-data operators: near-duplicate removal, chat formatting, quality rules, mixing, sharding,
license scans, packing, language-model scoring, exact vector search and WARC archives.

Nothing else in the library imports this package; `queries.py` holds the registered queries."""
