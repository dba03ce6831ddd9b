"""The engine's polled jobs as Structured Streaming queries."""
