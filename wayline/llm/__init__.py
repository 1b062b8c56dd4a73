"""Training-data operators: token counts, decontamination, neighbour search, threads, PII, URLs, language, shards, packing and near duplicates."""
