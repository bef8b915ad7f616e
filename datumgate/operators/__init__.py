"""Dataset onboarding operators: DataFrame in, DataFrame out."""
