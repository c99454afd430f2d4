"""Queries, each with the SQL that must give the same rows.  Importing a module registers its queries."""

from aeolith.plans import batches, complementary, contracts, correction, diagnosis, energy, ensembles, figures, grids, national, orchestration, statistics, stored, textual, trending  # noqa: F401
