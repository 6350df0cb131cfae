"""Incremental maintenance of the usage rollup with Structured Streaming."""
