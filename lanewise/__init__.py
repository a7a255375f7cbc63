"""Lanewise: pipeline traces and other lane-shaped interval data as Spark tables.

Tables (see `schemas`): ops, stages, deps, symbols, traces, rejects. Sources read event logs into
them, operators match, pair, exclude, rank, search and rasterise, all as lazy DataFrame plans.
"""
