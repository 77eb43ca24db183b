"""veritape: claim-verification analytics expressed as Spark DataFrame plans."""
