"""burstmill: burst-level radar analytics and corpus preparation as Spark jobs."""
