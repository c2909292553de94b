"""Training, tuning, calibration, gating and scoring with Spark ML."""
