"""Operators on texts and typed names; nothing outside this folder imports it."""
