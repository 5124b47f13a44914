"""Schemas, readers, writers and the bundle of tables every operator takes."""
