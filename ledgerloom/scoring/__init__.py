"""Scoring of agent responses as column expressions over a responses table."""
