"""DataFrame operators: JVM-side scans, intervals and counts; the exact kernel; bundles."""
