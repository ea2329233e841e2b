"""Column-level building blocks: naming rules, statistics and text helpers."""
