"""Streaming extensions: file-drop ingestion, re-upload filtering, format memory and the chain check."""
