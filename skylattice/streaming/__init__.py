"""Stateful operators as Structured Streaming queries; each shares its kernel with the batch form."""
