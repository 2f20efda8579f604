"""panelweave: repeated-survey panels on PySpark.

Prepare panels of counts or proportions observed on nested sampling units over several periods, fit the
same model for every entity and candidate in one distributed job, and return cell means, period contrasts,
residual checks and ranked effect tables as DataFrames.
"""

__version__ = "0.1.0"
