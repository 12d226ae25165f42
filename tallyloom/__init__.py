"""tallyloom: activity analytics and corpus preparation as Spark jobs."""
