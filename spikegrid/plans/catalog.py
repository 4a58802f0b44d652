"""All registered queries (importing the modules registers them)."""

from spikegrid.plans import base, contexts, field_sets, motion, null_scores, recordings, remap_tables, remapping, reports, signals, spatial, summaries, units  # noqa: F401

QUERIES = base.QUERIES
ORACLE = base.ORACLE
