"""crosspanel: Spark DataFrame operators for cross-sectional research on entity panels."""
