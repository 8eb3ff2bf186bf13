"""cadenza: time-series, statistics and spatial operators over Spark DataFrames."""

from cadenza.threads import single_threaded

single_threaded()
