"""Whole plans: the workspace API, the generated corpus and the registered queries."""
