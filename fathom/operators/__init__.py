"""Behavioural operators: funnels, cohorts, paths, sessions, JSON promotion and retention."""
