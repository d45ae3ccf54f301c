"""Whole runs: guarded SQL, processing, insights and charts."""
