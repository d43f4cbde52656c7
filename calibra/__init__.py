"""calibra — sensor-calibration and model-evaluation engine on Spark DataFrames."""

__version__ = "0.1.0"
