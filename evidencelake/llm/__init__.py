"""Operators of a training-data pipeline: scoring, mixing, decontamination, language, links, quality, joins, packing, lines, chat."""
