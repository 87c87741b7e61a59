"""refweave: Spark-first analytics over repositories, workflows and the references they trust."""
