"""quarrystone: security-findings analytics written as Spark DataFrame jobs."""
