"""Operators for preparing large text corpora: mixing, sharding, dedup, decontamination, scoring and archives."""
