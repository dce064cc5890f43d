"""The named analytic queries, each a function from tables to a frame."""
