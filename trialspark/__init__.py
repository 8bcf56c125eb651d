"""trialspark: encode-trial analytics as Spark DataFrame jobs."""
