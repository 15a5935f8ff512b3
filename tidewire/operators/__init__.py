"""Graph tables, scoring, alerts and retrieval as DataFrame operators."""
