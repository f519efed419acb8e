"""Operators over DataFrames: joins, ranking, queue, stubs, articles, images, reports."""
