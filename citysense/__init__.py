"""citysense: incident analytics as Spark DataFrame transforms.

Subpackages
-----------
functions   column expressions (calendar, keywords, grid, distances)
operators   ``DataFrame -> DataFrame`` operators (cleaning, spatial, profiling,
            time series, preparation, sampling, models, forecasting, evaluation)
sources     readers and writers
plans       end-to-end jobs and the fixture views over the driver tables
streaming   the grid operators on file streams
"""

__version__ = "0.1.0"
