"""panelfx: observational causal analysis on panel tables, expressed as
Spark DataFrame plans (cleaning, imputation, nuisance learners, effect
estimators, resampling and run-table evaluation)."""

__version__ = "0.1.0"
