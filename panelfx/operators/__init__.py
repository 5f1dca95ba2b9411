"""DataFrame operators: frames, profiles, runs, learners, effects, imputation, resampling."""
