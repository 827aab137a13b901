"""kpiforge.sources."""
