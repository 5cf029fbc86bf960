"""Training-data operators on text corpora; nothing outside this subpackage imports it."""
