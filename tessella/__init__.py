"""Document grounding, text scoring and learner analytics as Spark DataFrame jobs."""
