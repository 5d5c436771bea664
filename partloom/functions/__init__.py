"""Column expressions shared by the jobs. Everything here stays inside the JVM."""
