"""Training-data operators: dedup, tokenising, fixity, decontamination,
quality scoring, extraction, LM scoring and sharding.  Nothing else in the
library imports this subpackage."""
