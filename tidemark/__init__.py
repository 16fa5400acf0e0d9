"""Spark jobs over market ticks: capture, candles, prompts, features, forecasts, scores."""
