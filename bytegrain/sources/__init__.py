"""Where entries come from: directory trees, tables, ZIP archives, generated corpora."""
