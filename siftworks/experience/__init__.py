"""Candidate cleaning specs per dataset, the table of past runs, and what is learnt from it."""
