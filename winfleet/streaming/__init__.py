"""Structured Streaming: sensor jobs with bucketed text sinks, streamed latest state and streamed status changes."""
