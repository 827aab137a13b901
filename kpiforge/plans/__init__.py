"""kpiforge.plans."""
