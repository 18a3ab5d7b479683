"""Live run metrics. The reference has no stream processing; what it reports while a job runs is
progress (files and folders found, digests computed), kept here as ``Observation`` metrics."""
