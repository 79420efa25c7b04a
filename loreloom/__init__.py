"""Loreloom: a knowledge-base analytics engine written for Spark."""
