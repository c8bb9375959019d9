"""lectern: course-material preparation, retrieval, safety and analytics as Spark jobs."""
