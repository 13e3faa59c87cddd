"""Streams: archives that arrive in a folder, each normalized once."""
