"""kpiforge.operators."""
