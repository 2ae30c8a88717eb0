"""Region statistics over gridded multi-subject images, and corpus operators, as Spark jobs."""
