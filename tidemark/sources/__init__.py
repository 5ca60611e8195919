"""Readers that turn raw exchange files into typed tables."""
